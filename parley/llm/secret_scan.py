"""Secret scan: base patterns, and assignment-aware lexing of source and configuration syntax.

Base spans are leftmost non-overlapping matches of three patterns. The lexer reads a text as names, string
and bare literals and operators; pairs them from `name = literal`, `name: literal`, `"name": "literal"`, `name =>
literal`, `<name>literal</name>` and `name("literal")`; joins literals by `+`; and keeps a table of constants,
so `pw = BASE + "x"` marks the literal that BASE was given. A literal counts by the sensitivity of the name it
reaches and by its own look; from THRESHOLD on it is a span, of kind assign, unless a base span covers it.
Only texts that hold a stem of a sensitive name are lexed: others can't reach the threshold. Stems are sought among a text's
ASCII letters and digits alone, as the parts of a name may have anything else between them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parley.llm import words as W

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
STRONG = {"password", "passwd", "pwd", "passphrase", "passcode", "secret", "token", "credential", "credentials", "apikey", "bearer"}
KEY_OWNERS = {"api", "private", "access", "secret", "signing", "encryption", "master", "auth"}
NAME_STEMS = tuple(sorted({s.encode() for s in (*STRONG, "pass", "auth", *(f"{o}key" for o in KEY_OWNERS))}))
ABOUT = {"type", "name", "field", "length", "len", "count", "url", "uri", "path", "file", "id", "hint", "prompt", "label", "size", "limit", "ttl", "expiry", "expires", "policy", "regex", "pattern", "header", "index"}
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*|your.*|my.*|change.?me|example.*|sample.*|dummy.*|test.*|placeholder.*|none|null|true|false|undefined|redacted.*|todo.*|password\d{0,3}|secret\d{0,3}|token\d{0,3})$", re.IGNORECASE)
THRESHOLD = 4
LOOK = 256
def _lexer(quotes: str) -> re.Pattern:
    """Tokens of a text, strings among them only in the given quotes. Nothing can backtrack or has a greatest length."""
    strings = {'"': r"""\"\"\"(?s:.*?)\"\"\"|"(?:\\.|[^"\\\n])*+\"""", "'": r"""'(?:\\.|[^'\\\n])*+'""", "`": "`[^`]*+`"}
    text = "|".join(strings[q] for q in quotes) or "(?!)"
    return re.compile(
        rf"""(?P<text>{text})
        |(?P<name>[A-Za-z_$][A-Za-z0-9_$]*+(?:[.-][A-Za-z0-9_$]++)*+)
        |(?P<op>:=|=>|==|!=|<=|>=|\+=|</|[=:+,;(){{}}\[\]<>\n])
        |(?P<bare>[^\s"'`=:+,;(){{}}\[\]<>]++)
        |(?P<open>["'`])""",
        re.VERBOSE,
    )


LEXERS = {q: _lexer(q) for q in ("\"'`", "\"'", "\"`", "'`", '"', "'", "`", "")}
BARE = re.compile(r"[^\s\"'`,;<>(){}\[\]]++")
SPACE = re.compile(r"\s")
TAGGED = re.compile(r"[^\s<>]++(?=</)")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def sensitivity(name: str) -> int:
    """3 for names of passwords, secrets, tokens and keys, 0 for other names and names about them."""
    parts = [p.lower() for p in PARTS.findall(name)]
    if not parts or parts[-1] in ABOUT:
        return 0
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    if STRONG & ({*parts} | joined) or "pass" in parts[-1:]:
        return 3
    return 3 if any(b == "key" and a in KEY_OWNERS for a, b in zip(parts, parts[1:], strict=False)) else 2 if parts[-1] == "auth" else 0


def look(head: str, length: int, quoted: bool) -> int:
    """What a literal's own form says, by its length and its first LOOK characters: -9 for placeholders, up to 3 for long random strings."""
    if length < 8 or PLACEHOLDER.match(head):
        return -9
    n = len(head)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(head).values())
    kinds = sum(any(f(c) for c in head) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    if entropy < 2.0 or kinds < 2 and not (length >= 16 and entropy >= 3.0 and quoted):
        return -9
    if not quoted and not any(c.isdigit() for c in head):
        return -9
    return 1 + (length >= 16) + (entropy >= 3.5)


def lexed(text: str) -> Iterator[re.Match]:
    """The tokens. A quote that isn't closed (on its line, but for a back quote) is none, nor are the like ones that the search for its end passes over."""
    at, dead = 0, {}
    while True:
        m = LEXERS["".join(q for q in "\"'`" if at >= dead.get(q, 0))].search(text, at)
        if m is None:
            return
        at = m.end()
        if m.lastgroup != "open":
            yield m
        elif m.start() >= dead.get(m[0], 0):
            end = len(text) if m[0] == "`" else text.find("\n", at)
            dead[m[0]] = end if end >= 0 else len(text)


def _value(text: str, token: re.Match) -> tuple[int, int, bool]:
    """Span and quoting of a literal's content."""
    a, b = token.span()
    if token.lastgroup != "text":
        return a, b, False
    q = 3 if token[0].startswith('"""') and b - a >= 6 else 1
    return a + q, b - q, True


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name."""
    tokens = list(lexed(text))
    constants: dict[str, list[tuple[int, int, bool]]] = {}
    found: set[tuple[int, int]] = set()
    run = 0, 0  # the last bare literal's span: a part of it ends where it does

    def bare(at: int) -> int:
        nonlocal run
        if not run[0] <= at < run[1]:
            m = BARE.match(text, at)
            run = m.span() if m else (at, at)
        return run[1]

    @cache
    def spaced(a: int, b: int) -> bool:
        return SPACE.search(text, a, b) is not None

    def give(name: str, parts: list[tuple[int, int, bool]]) -> None:
        if not parts:
            return
        constants[name] = parts = list(dict.fromkeys(parts))  # x = x + x doesn't grow
        rank = sensitivity(name)
        if not rank or any(spaced(a, b) for a, b, quoted in parts if quoted):
            return
        head, length = "", 0
        for a, b, _ in parts:
            head += text[a : min(b, a + LOOK - len(head))]
            length += b - a
        if rank + look(head, length, any(q for _, _, q in parts)) >= THRESHOLD:
            found.update((a, b) for a, b, _ in parts)

    i, n = 0, len(tokens)
    while i < n:
        t = tokens[i]
        if t.lastgroup not in ("name", "text") or i + 2 >= n:
            i += 1
            continue
        name = t[0] if t.lastgroup == "name" else t[0].strip("\"'`")
        op, j = tokens[i + 1], i + 2
        if op[0] == "]" and tokens[j][0] in ("=", ":", "=>"):  # config["name"] = ...
            op, j = tokens[j], j + 1
        if j < n and op[0] in ("=", ":", ":=", "=>", "+="):
            parts: list[tuple[int, int, bool]] = list(constants.get(name, [])) if op[0] == "+=" else []
            k = j
            while k < n:
                v = tokens[k]
                if v.lastgroup == "text":
                    parts.append(_value(text, v))
                elif v.lastgroup in ("name", "bare") and v[0] in constants:
                    parts += constants[v[0]]
                elif v.lastgroup in ("name", "bare"):
                    if k == j and (end := bare(v.start())) > v.start() and text[end : end + 1] != "(":
                        parts.append((v.start(), end, False))
                    break
                else:
                    break
                if k + 2 < n and tokens[k + 1][0] == "+":
                    k += 2
                else:
                    break
            give(name, parts)
            i = max(j, i + 1)
            continue
        if t.lastgroup == "name" and op[0] == "(" and tokens[j].lastgroup == "text" and j + 1 < n and tokens[j + 1][0] == ")":
            give(name, [_value(text, tokens[j])])
        elif t.lastgroup == "name" and op[0] == ">" and i and tokens[i - 1][0] == "<" and (m := TAGGED.match(text, op.end())):
            give(name, [(*m.span(), True)])
        i += 1
    return sorted(found)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches, by start, then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text."""
    base = base_spans(text)
    added = [("assign", a, b) for a, b in lexed_spans(text) if b > a and not any(s <= a and b <= e for _, s, e in base)]
    return base, sorted({*base, *added}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


_NAME_BYTE = np.zeros(256, bool)
_NAME_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*range(48, 58), *range(97, 103)]] = True


def suspects(column: pa.Array) -> Iterator[int]:
    """Rows that can hold any span: by stems, AKIA or a run of 16 hex digits, all found in the bytes of a chunk at once."""
    raw, offsets = W.text_buffer(column)
    for a, b in W.chunks(offsets):
        low, cut = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        data = low.tobytes()
        named, at = _NAME_BYTE[low], set()
        packed = np.concatenate([[0], np.cumsum(named)])[cut]
        for where, ends, stems in ((low[named].tobytes().lower(), packed, NAME_STEMS), (data, cut, (b"AKIA",))):
            for stem in stems:
                p = where.find(stem)
                while p >= 0:
                    row = int(np.searchsorted(ends, p, "right")) - 1
                    at.add(row)
                    p = where.find(stem, int(ends[row + 1]))
        hexed = np.concatenate([[False], _HEX_BYTE[low], [False]])
        edges = np.flatnonzero(hexed[1:] != hexed[:-1])
        long = (edges[1::2] - edges[0::2]) >= 16
        # texts lie end to end: a run can reach over several rows, each of which is looked at
        for p, q in zip(edges[0::2][long].tolist(), edges[1::2][long].tolist(), strict=True):
            at.update(range(int(np.searchsorted(cut, p, "right")) - 1, int(np.searchsorted(cut, q - 1, "right"))))
        yield from (a + i for i in sorted(at))


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans: a row for each row.

    Positions are code points, ends exclusive. Null and empty texts have no spans (empty string, and its
    SHA-256). Rows with repeated or null ids keep their rows; other columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = [(0, 0, 0, none, "")] * batch.num_rows
            texts = batch.column("text")
            for i in suspects(texts):
                base, every = spans(texts[i].as_py() or "")
                count = Counter(k for k, _, _ in base)
                rows[i] = (*(count[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every))
            types = (pa.int64(),) * 3 + (pa.string(),) * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with each span of a text (overlapping ones together) replaced by mark, and n_chars, where there is one, set anew.

    Null and empty texts, repeated rows, null ids and other columns pass as they are; an empty table gives none.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = batch.column("text"), {}
            for i in suspects(texts):
                text = texts[i].as_py() or ""
                out, at = [], 0
                for _, a, b in spans(text)[1]:
                    if a >= at:
                        out += [text[at:a], mark]
                    at = max(at, b)
                if out:
                    changed[i] = "".join([*out, text[at:]])
            if changed:
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                columns["text"] = pa.array([changed.get(i, v) for i, v in enumerate(texts.to_pylist())], texts.type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(columns["n_chars"].to_pylist())], columns["n_chars"].type)
                batch = pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, schema)
