"""One huge JSON document read by many tasks.

A document is an array of records, an object that holds them under a key (the
envelope), or one object.  Spark's ``multiLine`` reader takes a file as one task.
Here the file is read as text cut at ``}``, which Spark splits by blocks, and two
passes find the records:

1. each block is reduced to what it does to the reader's state: whether it ends
   inside a string, how many brackets it closes that it did not open, and which it
   leaves open -- for a block that begins outside a string and for one that begins
   inside.  A block is one small row, and folding a file's rows in order gives the
   state at the start of each block;
2. each block, told its state, cuts its records.  Only what stands before its
   first and after its last whole record goes through a shuffle, to be put
   together with the neighbours' pieces.

A ``}`` is never escaped in JSON, so a cut after it never splits an escape or a
key from its bracket.  Records are parsed by Spark's JSON reader.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surv.session import materialize

CLOSE = "}"
TOKEN = r'"[^"\\]*(?:\\.[^"\\]*)*"|["{}\[\]]'
STRING_REST = r'[^"\\]*(?:\\.[^"\\]*)*"'
MANY_BLOCKS = 200_000          # beyond this many blocks their states are joined, not broadcast

SUMMARY = "file string, block long, first string, " + ", ".join(
    f"m{m} struct<inside:boolean,closed:int,opened:string,keyed:array<int>>" for m in (0, 1))
STATE = "file string, block long, inside boolean, stack string, level int, record long"


class Scanner:
    """Walks over the tokens of a text; ``stack`` holds the open brackets, ``T`` for
    the array under the envelope's key, and ``closed`` counts brackets closed that
    were not opened here."""

    def __init__(self, envelope: str | None, inside: bool = False, stack: str = ""):
        self.token, self.rest = re.compile(TOKEN, re.S), re.compile(STRING_REST, re.S)
        self.between = re.compile(r"\s*:\s*")
        self.key = None if envelope is None else f'"{envelope}"'
        self.inside, self.stack, self.closed = inside, list(stack), 0
        self.keyed: set[int] = set()
        self.first: str | None = None

    def walk(self, text: str):
        """Yields (bracket, start, end) with the stack as it is after an opening and
        before a closing bracket."""
        at = 0
        if self.inside:
            m = self.rest.match(text)
            if not m:
                return
            self.inside, at = False, m.end()
        last, last_end = "", at
        for m in self.token.finditer(text, at):
            t = m.group()
            if t == '"':
                self.inside = True        # no end in this text
                return
            if t in "[{":
                if t == "[" and last == self.key and self.between.fullmatch(text, last_end, m.start()):
                    t = "T"
                self.first = self.first or t
                self.stack.append(t)
                if t == "T":
                    self.keyed.add(len(self.stack) - self.closed)
                yield t, m.start(), m.end()
            elif t in "]}":
                yield t, m.start(), m.end()
                if self.stack:
                    self.stack.pop()
                else:
                    self.closed += 1
            last, last_end = t, m.end()


def _runs(batches):
    """((file, block), text, whether the block ends with it) of rows in file order:
    a batch's rows of one block make one text."""
    held = None
    for b in batches:
        keys, values = list(zip(b["file"].to_pylist(), b["block"].to_pylist())), b["value"].to_pylist()
        i = 0
        while i < len(keys):
            j = i
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            if held:
                yield *held, held[0] != keys[i]
            held = keys[i], CLOSE.join(values[i:j]) + CLOSE
            i = j
    if held:
        yield *held, True


def _summaries(pieces: DataFrame, envelope: str | None) -> DataFrame:
    def task(batches):
        scan = None
        for key, text, last in _runs(batches):
            scan = scan or (Scanner(envelope), Scanner(envelope, inside=True))
            for s in scan:
                for _ in s.walk(text):
                    pass
            if last:
                made = [{"inside": s.inside, "closed": s.closed, "opened": "".join(s.stack), "keyed": sorted(s.keyed)} for s in scan]
                yield pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "first": scan[0].first, "m0": made[0], "m1": made[1]}], schema)
                scan = None

    mode = pa.struct([("inside", pa.bool_()), ("closed", pa.int32()), ("opened", pa.string()), ("keyed", pa.list_(pa.int32()))])
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.string()), ("m0", mode), ("m1", mode)])
    return pieces.mapInArrow(lambda batches: task(batches), SUMMARY)


def _states(summaries: DataFrame) -> DataFrame:
    """The state at the start of each block, by a fold over a file's blocks (one
    small row each).  ``level`` is the depth that records stand at; ``record`` is the
    block in which the record that is open at the start began."""
    def fold(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["block"])
        inside, stack, starts, keyed = False, "", [], False
        for r in rows:
            m = r["m1"] if inside else r["m0"]
            starts.append((inside, stack))
            keyed |= any(len(stack) + k == 2 for k in m["keyed"])
            stack = stack[: max(0, len(stack) - m["closed"])] + m["opened"]
            inside = m["inside"]
        first = next((r["first"] for r in rows if r["first"]), "[")
        level = 2 if first == "{" and keyed else 0 if first == "{" else 1
        out, record = [], None
        for r, (inside, stack) in zip(rows, starts):
            out.append({"file": r["file"], "block": r["block"], "inside": inside, "stack": stack, "level": level, "record": record})
            m = r["m1"] if inside else r["m0"]
            kept = max(0, len(stack) - m["closed"])
            after = stack[:kept] + m["opened"]
            if not open_record(after, level):
                record = None
            elif record is None or kept <= level:
                record = r["block"]
        return pa.Table.from_pylist(out, schema)

    def open_record(stack: str, level: int) -> bool:
        return len(stack) > level and stack[level] == "{" and (level < 2 or stack[1] == "T")

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("stack", pa.string()), ("level", pa.int32()), ("record", pa.int64())])
    return summaries.groupBy("file").applyInArrow(lambda t: fold(t), STATE)


def _records(pieces: DataFrame, states: DataFrame, envelope: str | None) -> DataFrame:
    """``file, record, block, value``: whole records (``record`` null) and the parts
    of those that cross blocks."""
    broad = states.count() <= MANY_BLOCKS
    j = pieces.join(F.broadcast(states) if broad else states, ["file", "block"])
    if not broad:
        j = j.repartition("file", "block").sortWithinPartitions("file", "block", "seq")

    def task(batches):
        scan = None
        out: list[dict] = []
        heads: dict = {}

        def seen():
            for b in batches:
                for f, k, i, s, lv, r in zip(*(b[c].to_pylist() for c in ("file", "block", "inside", "stack", "level", "record"))):
                    heads.setdefault((f, k), (i, s, lv, r))
                yield b

        for (file, block), text, last in _runs(seen()):
            if scan is None:
                inside, stack, level, record = heads.pop((file, block))
                scan, open_at = Scanner(envelope, inside, stack), record
                held = [] if record is not None else None       # text of the open record so far
            begin = 0
            for t, a, z in scan.walk(text):
                depth = len(scan.stack)
                if depth != level + 1 or (level == 2 and scan.stack[1] != "T"):
                    continue
                if t == "{":
                    begin, held, open_at = a, [], None
                elif t == "}" and held is not None and scan.stack[level] == "{":
                    value = "".join(held) + text[begin:z]
                    out.append({"file": file, "record": open_at, "block": block, "value": value})
                    held, open_at = None, None
            if held is not None:
                held.append(text[begin:])
            if last:
                if held is not None:
                    out.append({"file": file, "record": block if open_at is None else open_at, "block": block, "value": "".join(held)})
                scan = None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []

    schema = pa.schema([("file", pa.string()), ("record", pa.int64()), ("block", pa.int64()), ("value", pa.string())])
    return j.select("file", "block", "value", "inside", "stack", "level", "record").mapInArrow(
        lambda batches: task(batches), "file string, record long, block long, value string")


def read_json_texts(spark: SparkSession, path, envelope: str | None = None) -> DataFrame:
    """One row ``value`` per record of the documents: the elements that are objects
    of a top-level array or of the array under ``envelope``; else the document."""
    text = spark.read.option("lineSep", CLOSE).text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("seq"), "value")
    states = materialize(_states(_summaries(pieces.select("file", "block", "value"), envelope)), "json-states")
    cut = materialize(_records(pieces, states, envelope), "json-records")
    parts = cut.where("record IS NOT NULL").groupBy("file", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "value"))), lambda x: x.value), "").alias("value"))
    return cut.where("record IS NULL").select("value").unionByName(parts.select("value"))


def parse_json_texts(texts: DataFrame, schema: T.StructType | str | None = None) -> DataFrame:
    """Spark's JSON reader over a column of texts."""
    spark = texts.sparkSession
    reader = spark._jsparkSession.read()
    if schema is not None:
        reader = reader.schema(schema if isinstance(schema, str) else schema.simpleString())
    strings = getattr(texts.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader.json(strings), spark)


def read_json_split(spark: SparkSession, path, envelope: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of ``spark.read.json(path, multiLine=True)`` (of the envelope's
    elements, where there is one), read by as many tasks as the files have blocks."""
    return parse_json_texts(read_json_texts(spark, path, envelope), schema)
