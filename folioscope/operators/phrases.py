"""Phrases of a lexicon table in texts: one pass over a text, however many phrases there are.

The routing rules look for a few dozen phrases, one ``contains`` each.  Packs of 10^5
phrases come as a table (phrase, tag); an automaton of all of them is built once in each
worker and run over Arrow batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Phrases that may travel to the workers.
MOST_PHRASES = 1_000_000
_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, pairs: list[tuple[str, str]]) -> ahocorasick.Automaton:
    """Each phrase with its tags; kept in the worker for later tasks."""
    if key not in _BUILT:
        made, tags = ahocorasick.Automaton(), {}
        for phrase, tag in pairs:
            tags.setdefault(phrase, []).append(tag)
        for phrase, own in tags.items():
            made.add_word(phrase, own)
        made.make_automaton()
        _BUILT.clear()  # one lexicon at a time is held
        _BUILT[key] = made
    return _BUILT[key]


def with_tags(rows: DataFrame, text: Column, lexicon: DataFrame, name: str = "tags") -> DataFrame:
    """``rows`` with ``name``: the tags, sorted, of all phrases of ``lexicon`` (phrase, tag) that ``text`` holds.

    Phrases are found anywhere, within words too, in lower case on both sides.  Null
    and empty texts have no tags; null and empty phrases, and null tags, are left out;
    a column called ``name`` is replaced.  Lexicons of over ``MOST_PHRASES`` are refused.
    """
    sound = lexicon.select(F.lower("phrase").alias("phrase"), "tag").filter("phrase <> '' AND tag IS NOT NULL").distinct()
    pairs = [tuple(r) for r in sound.limit(MOST_PHRASES + 1).collect()]
    if len(pairs) > MOST_PHRASES:
        raise ValueError(f"the lexicon holds more than {MOST_PHRASES} phrases")
    rows = rows.drop(name)
    sent, key, kept = rows.sparkSession.sparkContext.broadcast(pairs), uuid.uuid4().hex, rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(key, sent.value)
        for b in batches:
            tags = [sorted({t for _, own in found.iter(x) for t in own}) if x and len(found) else [] for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(tags, pa.list_(pa.string()))], [*kept, name])

    schema = StructType([*rows.schema.fields, StructField(name, ArrayType(StringType()))])
    return rows.select("*", F.lower(text).alias("_text")).mapInArrow(run, schema)
