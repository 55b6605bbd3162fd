"""Structured Streaming entry points.

No stream operators are part of the inventory; "stream-read" there means
chunked reading of arriving files. Here a folder that receives files is a
streaming source, and the same DataFrame operators run over it: cleaning
expressions per micro-batch, grouped roll-ups (for example the per-task
run report) as stateful streaming aggregates whose state lives in the
checkpoint folder, so a restarted query resumes where it stopped.
"""

from tablework.streaming.files import stream_table, write_stream

__all__ = ["stream_table", "write_stream"]
