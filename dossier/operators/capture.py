"""Parsers that may fail, applied document by document: what one of them does to a document stays with that document.

A parser is a plain function of (key, content) that gives pages and perhaps figures. It runs in Arrow batches; an exception, a result
that isn't of the right shape, a document that is too large or one that takes too long becomes that row's outcome, and the others go on.
"""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PAGES = "array<struct<page_num: int, text: string, screenshot: binary, width: int, height: int>>"
FIGURES = "array<struct<page_num: int, kind: string, image: binary>>"
OUTCOME = f"key string, doc_id string, ok boolean, retriable boolean, reason string, pages {PAGES}, figures {FIGURES}"
#: Bytes of a document, seconds for it, and characters of a reason.
MOST_BYTES, MOST_SECONDS, REASON_CHARS = 256 << 20, 300.0, 500

#: What a parser gives: pages, or {"pages": pages, "figures": figures}; pages and figures are lists of dicts.
Parser = Callable[[str, bytes], list[dict] | dict]


class Unparseable(Exception):
    """Raised by a parser for a document that no later attempt can parse: it is skipped, not failed."""


@contextmanager
def at_most(seconds: float | None) -> Iterator[None]:
    """A TimeoutError in what runs for longer. Code that doesn't come back to Python is only interrupted when it does; outside of a process's main thread there is no limit."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_) -> None:
        raise TimeoutError(f"took more than {seconds:g} s")

    was = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, was)


def outcome(parse: Parser, key: str, content: bytes | None, most_bytes: int, seconds: float | None, kinds: list[pa.DataType]) -> tuple:
    """(ok, retriable, reason, pages, figures) of one document."""
    if content is None:
        return False, True, "fetch failed", None, None
    if len(content) > most_bytes:
        return False, False, f"{len(content)} bytes are more than {most_bytes}", None, None
    try:
        with at_most(seconds):
            made = parse(key, content)
        made = made if isinstance(made, dict) else {"pages": made}
        pages, figures = made.get("pages") or [], made.get("figures") or []
        for value, kind in zip((pages, figures), kinds):
            pa.array([value], kind)  # else one document's wrong shape would end its whole batch
        if not pages:
            return False, False, "no pages", None, None
        return True, False, "", pages, figures
    except Unparseable as problem:
        return False, False, str(problem)[:REASON_CHARS] or "unparseable", None, None
    except Exception as problem:  # noqa: BLE001 - whatever a parser raises is that document's outcome
        return False, True, f"{type(problem).__name__}: {problem}"[:REASON_CHARS], None, None


def captured(parse: Parser, most_bytes: int = MOST_BYTES, seconds: float | None = MOST_SECONDS) -> Callable[[DataFrame], DataFrame]:
    """What ``ingest`` takes as parse_binary, from a parser of single documents: rows (key, doc_id, content) to OUTCOME, one for each.

    Unparseable documents, those without pages and those of more than ``most_bytes`` are not to be tried again; all other failures are.
    Each outcome leaves for the JVM by itself, so that a task holds the pages of one document at a time.
    """
    schema = to_arrow_schema(StructType.fromDDL(OUTCOME))
    kinds = [schema.field("pages").type, schema.field("figures").type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                key, doc_id, content = (b.column(c)[i].as_py() for c in range(3))
                row = (key, doc_id, *outcome(parse, key, content, most_bytes, seconds, kinds))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return lambda rows: rows.select("key", "doc_id", "content").mapInArrow(run, OUTCOME)
