"""Records that span lines, read by many tasks: CSV with line breaks in quotes, and JSON arrays of records.

The built-in readers give such a file to one task, because a split can't know whether it starts inside a quoted field or
how deep inside an array it is.  Here every split finds out, in three steps over the plain text source (which cuts files
at line feeds, or for JSON at closing braces, and so stays splittable):

1. **Scan.**  Each split is summarised by what it does to the reader's state: whether it flips "inside quotes", and by how
   much the depth changes, for either state at its start.  Such summaries compose.
2. **Prefix.**  Running sums over the splits of a file (one small row each) give every split's state at its start.
3. **Assembly.**  Each split cuts its text into records.  What lies before the first and after the last record end are
   pieces of a record that crosses borders; these few pieces are put together by file and order.

The records are written as plain lines with a separator that the text doesn't hold, and the built-in CSV or JSON reader
reads them: types, inference and options are its own.

Quotes may only stand around fields, doubled inside them, and a backslash in JSON may not stand before ``}`` (no valid
escape).  Elements of a JSON array that aren't objects are left out, and a nested value that inference reads as text shows
its line breaks as spaces.  A file without a final quote keeps its last
record up to the end of the file.  Files that Spark can't split (gzip) are one split.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Splits whose states are broadcast (about 40 bytes each); beyond, their texts are shuffled to them.
BROADCAST_SPLITS = 200_000
#: Separators for the rewritten records, the first that no text holds is taken.
SEPARATORS = "\x1e\x1f\x1d\x1c\x02\x03"
WHOLE, HEAD, TAIL, FIRST = range(4)

_ESCAPE = re.compile(r"\\.", re.DOTALL)


def _texts(spark: SparkSession, path: str, end: str) -> DataFrame:
    """Text pieces between ``end`` with the file and split they start in; a split's pieces are in order within one task."""
    return spark.read.option("lineSep", end).text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _csv_effect(text: str) -> tuple[int, int, int]:
    return text.count('"') & 1, 0, 0


def _json_effect(text: str) -> tuple[int, int, int]:
    """Flips "in a string"; change of depth for a start outside and inside a string, the closing brace after the text included."""
    parts = (_ESCAPE.sub("", text) if "\\" in text else text).split('"')
    flip = (len(parts) - 1) & 1
    deep = [sum(p.count("{") + p.count("[") - p.count("]") for p in parts[k::2]) for k in (0, 1)]
    return flip, deep[0] - (1 - flip), deep[1] - flip


EFFECTS = {"\n": _csv_effect, "}": _json_effect}


def _runs(batches: Iterator) -> Iterator[tuple[tuple, list, bool]]:
    """``(key columns, texts, starts)`` for consecutive texts of one split; ``starts`` at a split's first."""
    key = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:-1]]
        texts = batch.column(batch.num_columns - 1).to_pylist()
        at = 0
        while at < len(texts):
            mine = tuple(c[at] for c in columns)
            to = at + 1
            if columns[0][-1] == mine[0] and columns[1][-1] == mine[1]:
                to = len(texts)
            else:
                while to < len(texts) and columns[0][to] == mine[0] and columns[1][to] == mine[1]:
                    to += 1
            yield mine, texts[at:to], mine != key
            key, at = mine, to


def split_effects(texts: DataFrame, end: str) -> DataFrame:
    """Per split ``(file, split, flip, outside, inside)``: what it does to the state at its start."""
    effect = EFFECTS[end]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        done: list[tuple] = []
        for (file, split), part, starts in _runs(batches):
            if starts:
                done.append((file, split, 0, 0, 0))
            _, _, flip, outside, inside = done[-1]
            for text in part:
                f, a, b = effect(text)
                # a start outside a string is inside one now if the text so far has flipped it, and the other way round
                outside, inside, flip = outside + (b if flip else a), inside + (a if flip else b), flip ^ f
            done[-1] = (file, split, flip, outside, inside)
        columns = list(zip(*done, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["file", "split", "flip", "outside", "inside"])

    return texts.mapInArrow(run, "file bigint, split bigint, flip bigint, outside bigint, inside bigint")


def split_states(effects: DataFrame) -> DataFrame:
    """Per split the state at its start: ``quoted`` (0 or 1) and ``depth``."""
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    quoted = effects.withColumn("quoted", F.coalesce(F.sum("flip").over(before), F.lit(0)) % 2)
    change = F.when(F.col("quoted") == 1, F.col("inside")).otherwise(F.col("outside"))
    return quoted.withColumn("change", change).select("file", "split", "quoted", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"))


def _cut(texts: DataFrame, end: str, edges: bool) -> DataFrame:
    """Records of every split (``edges`` false), or the pieces at its borders and a file's first record: ``file, split, kind, text``."""
    effect, closes = EFFECTS[end], 1 if end == "}" else 0

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple] = []
        open_, quoted, depth, kind, split_key = [], 0, 0, WHOLE, None

        def ended(last: bool) -> None:
            """A record's end, or (``last``) the end of the split's texts."""
            nonlocal open_, kind
            text = end.join(open_) + (end if end == "}" or last else "")
            made = kind if not last else HEAD if kind == HEAD else TAIL
            if made in (HEAD, TAIL, FIRST) or last:
                first = kind == FIRST
                if edges:
                    out.append((*split_key, made, first, text))
            elif not edges:
                out.append((*split_key, made, False, text))
            open_, kind = [], WHOLE

        for (file, split, start_quoted, start_depth), part, starts in _runs(batches):
            if starts:
                if open_:
                    ended(True)
                split_key, quoted, depth = (file, split), start_quoted, start_depth
                within = bool(quoted) or depth > closes
                kind = HEAD if within else FIRST if split == 0 else WHOLE
            for text in part:
                f, a, b = effect(text)
                depth += b if quoted else a
                quoted ^= f
                open_.append(text)
                if not quoted and depth == closes:
                    ended(False)
            if len(out) >= 4096:
                yield _batch(pa, out)
                out = []
        if open_:
            ended(True)
        yield _batch(pa, out)

    def _batch(pa, rows: list[tuple]):
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "split", "kind", "first", "text"])

    return texts.mapInArrow(run, "file bigint, split bigint, kind int, first boolean, text string")


def _crossing(pieces: DataFrame) -> DataFrame:
    """Border pieces put together: ``(file, first, text)``; each file's pieces are a few per split."""
    order = Window.partitionBy("file").orderBy("split", "kind").rowsBetween(Window.unboundedPreceding, 0)
    part = pieces.filter(f"kind <> {FIRST}").withColumn("nth", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    return part.groupBy("file", "nth").agg(
        F.max("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "kind", "text"))), lambda p: p["text"]), "").alias("text")
    ).select("file", "first", "text")


def framed(spark: SparkSession, path: str, end: str) -> tuple[DataFrame, DataFrame]:
    """All records ``(file, text)`` of the files but each file's first, and the first ones."""
    texts = _texts(spark, path, end)
    states = split_states(split_effects(texts, end))
    kept = scratch_path(spark, "split-states")
    states.write.parquet(kept)
    states = spark.read.schema(states.schema).parquet(kept)
    n = states.count()
    if n <= BROADCAST_SPLITS:
        met = texts.join(F.broadcast(states), ["file", "split"])  # keeps the order of a task's texts
    else:
        met = (texts.withColumn("__at", F.monotonically_increasing_id()).hint("merge").join(states, ["file", "split"])
               .repartition("file", "split").sortWithinPartitions("file", "split", "__at"))
    met = met.select("file", "split", "quoted", "depth", "value")
    pieces = _cut(met, end, edges=True)
    crossing = _crossing(pieces)
    first = pieces.filter(f"kind = {FIRST}").select("file", "text").unionByName(crossing.filter("first").select("file", "text"))
    rest = _cut(met, end, edges=False).select("file", "text").unionByName(crossing.filter("NOT first").select("file", "text"))
    return rest, first


def _names(header: str, sep: str) -> list[str]:
    """Column names of a header record, by the built-in reader's rules for missing and repeated ones."""
    names = next(csv.reader([header], delimiter=sep), [])
    folded = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if folded.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_csv_records(spark: SparkSession, path: str, *, sep: str, schema: T.StructType | None, options: dict) -> DataFrame:
    """CSV files with a header whose quoted fields may hold line breaks, any file cut between many tasks."""
    rest, first = framed(spark, path, "\n")
    bare = F.regexp_replace("text", "\r?\n?$", "")
    header = first.orderBy("file").select(bare.alias("text")).first()
    held = rest.agg(*[F.bool_or(F.col("text").contains(s)).alias(f"s{k}") for k, s in enumerate(SEPARATORS)]).first()
    mark = next((s for k, s in enumerate(SEPARATORS) if not held[k]), None)
    if mark is None:
        raise ValueError("the file holds every control character that could separate its records")
    kept = scratch_path(spark, "csv-records")
    rest.select(bare.alias("text")).filter("text <> ''").write.option("lineSep", mark).text(kept)
    reader = spark.read.options(**options).option("header", False).option("sep", sep).option("lineSep", mark)
    if schema is not None:
        return reader.schema(schema).csv(kept)
    names = _names(header["text"], sep) if header else []
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    found = reader.option("inferSchema", True).csv(kept)
    if len(found.columns) != len(names):  # no row, or ragged ones: the header decides
        texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
        return reader.schema(texts).csv(kept)
    return found.toDF(*names)


def read_json_records(spark: SparkSession, path: str, *, schema: T.StructType | None, options: dict) -> DataFrame:
    """JSON files that each hold one array of records, any file cut between many tasks."""
    rest, first = framed(spark, path, "}")
    # what stands between two records, and the brackets around them, goes; line breaks are white space outside strings
    record = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    kept = scratch_path(spark, "json-records")
    (rest.unionByName(first).select(F.translate(record, "\n\r", "  ").alias("text")).filter("text <> ''")).write.text(kept)
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).json(kept)
