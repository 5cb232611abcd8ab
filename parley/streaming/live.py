"""Structured Streaming: gap sessions of events, live turns with a change-of-speaker rule, heartbeats, incremental indexing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

PAUSE = 1.5


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """events(user_id, ts, value) -> sessions that a gap ends, closed when the watermark passes. ts may be without a time zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.session_window("ts", gap)
    return timed.groupBy("user_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "total")


def live_turns(words: DataFrame, pause: float = PAUSE) -> DataFrame:
    """A stream of words(conv_id, pos, speaker, word, start_s, end_s), in order within a recording -> turns as they end, with the reason.

    The state of a recording is its open turn only: counts, bounds and text so far. A word with speaker null ends the recording.
    """
    state = "speaker string, turn_id long, start double, end double, text string"

    def run(key: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        speaker, turn, start, end, text = st.get if st.exists else (None, 1, 0.0, 0.0, "")
        rows = pd.concat(list(batches)).sort_values("pos")
        done = []
        for w in rows.itertuples():
            closing = w.speaker is None or pd.isna(w.speaker)
            reason = None
            if speaker is not None:
                reason = "end_of_audio" if closing else "speaker_change" if w.speaker != speaker else "pause" if w.start_s - end > pause else None
            if reason:
                done.append((key[0], turn, speaker, round(start, 3), round(end, 3), reason, text))
                turn, text, speaker = turn + 1, "", None
            if closing:
                continue
            start = w.start_s if speaker is None else start
            speaker, end, text = w.speaker, w.end_s, f"{text} {w.word}".strip()
        st.update((speaker, turn, start, end, text))
        yield pd.DataFrame(done, columns=["conv_id", "turn_id", "speaker", "start_s", "end_s", "split_reason", "text"])

    out = "conv_id long, turn_id long, speaker string, start_s double, end_s double, split_reason string, text string"
    return words.groupBy("conv_id").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def heartbeats(events: DataFrame) -> DataFrame:
    """The last sign of life of each worker(user_id); a reader compares it with the clock."""
    return events.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))


def index_batches(chunks: DataFrame, store, name: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch of chunks(workspace, file_id, ...) into a Store: a recording that comes again replaces itself, so a repeated batch changes nothing."""
    return chunks.writeStream.foreachBatch(lambda batch, _: store.write(name, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
