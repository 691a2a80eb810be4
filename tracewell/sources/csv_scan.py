"""CSV files as records, worked out in tasks whatever the number of files and splits.

A CSV record may reach over several lines, and whether a line begins inside quotes depends on
all lines before it. So each split is first summed up as a function of the state it begins in:
the state it ends in, and how many records begin in it. Such functions are constant, the
identity or a negation, and compose along a file by window sums; that gives each split its state
and first record number, and one parser then reads every split on its own. The record that a
split's edge cuts is put together from its pieces.

Dialect and header of a file are found in the task that reads its first split, and stay in a
table. Facts of files and splits are joined to the lines: broadcast if their measured size is
small, otherwise lines are sorted by split beside them.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.cluster import cut_lineage

# Functions that run in Python workers travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOM = "﻿"
# Texts of parse errors.
BAD_HEADER = "CSV header is missing or contains an empty name"
REPEATED_HEADER = "CSV header contains duplicate names"
LONG_HEADER = "CSV header contains a name that is too long"
#: Fixed value: characters the dialect is guessed from.
_SNIFFED = 8192
#: What a payload can have as a key, in characters.
_NAME_CHARS = 50_000
#: Characters of a record that are held; a longer one is an error record.
RECORD_CHARS = 1 << 24
#: Bytes a header is looked for in; it has to end in the first split of its file as well.
_HEADER_BYTES = 1 << 25
#: What facts joined to every line may weigh to be broadcast.
BROADCAST_BYTES = 32 << 20

_DIALECT = "encoding string, delimiter string, quote string, doubled boolean, skip boolean"
_PIECE = (
    "file_path string, start long, record_index long, sha string, cells array<string>, "
    "error string, body string"
)


def _lines_by_split(batches, *facts: str):
    """``(path, start, facts, iterator over all lines)`` of each split of a task, in order."""
    import itertools

    def portions():
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("file_path", "start", *facts)]
            lines = batch.column("line").to_pylist()
            keys = list(zip(*columns))
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i][:2] != keys[at][:2]:
                    yield keys[at], lines[at:i]
                    at = i

    for key, group in itertools.groupby(portions(), key=lambda p: p[0]):
        yield key, (line for _, part in group for line in part)


# -- dialect and header --------------------------------------------------------------------


def _guess(text: str) -> dict:
    import csv

    try:
        found = csv.Sniffer().sniff(text[:_SNIFFED], delimiters=",;")
    except csv.Error:
        found = csv.excel
    return {
        "delimiter": found.delimiter,
        "quotechar": found.quotechar,
        "doublequote": bool(found.doublequote),
        "skipinitialspace": bool(found.skipinitialspace),
    }


def _header_ends(lines: list[bytes]) -> bool:
    """Whether the first record is complete, however the file's bytes are to be decoded."""
    for encoding in ("utf-8", "latin-1"):
        text = b"\n".join(lines).decode(encoding, "ignore").removeprefix(BOM)
        options, inside = _guess(text), False
        for line in text.split("\n"):
            inside = _ends_inside(line, inside, options)
            if not inside:
                break
        if inside:
            return False
    return True


def _facts_of_splits(batches):
    """What a split says about its file: encodings that fit, any text, the first characters.

    Of a file's first split the sniffed characters are kept, and the header to its end.
    """
    import pyarrow as pa

    for (path, start), lines in _lines_by_split(batches):
        utf8 = cp1252 = True
        filled, head, held, enough = False, [], 0, start != 0
        wanted = 4 * _SNIFFED
        for line in lines:
            if utf8:
                try:
                    line.decode("utf-8")
                except UnicodeDecodeError:
                    utf8 = False
            if cp1252:
                try:
                    line.decode("cp1252")
                except UnicodeDecodeError:
                    cp1252 = False
            filled = filled or bool(line.strip())
            if not enough:
                head.append(line)
                held += len(line) + 1
                if held >= wanted:
                    enough = held > _HEADER_BYTES or _header_ends(head)
                    wanted = 2 * held  # so that an open header is tried few times
        yield pa.RecordBatch.from_pydict(
            {
                "file_path": [path],
                "utf8": [utf8],
                "cp1252": [cp1252],
                "filled": [filled],
                "head": pa.array([b"\n".join(head) if start == 0 else None], pa.binary()),
            }
        )


def _dialects(batches):
    """Encoding, dialect and header of files, or the problem that makes one unreadable."""
    import csv
    import io

    import pyarrow as pa

    for batch in batches:
        rows = []
        for fact in batch.to_pylist():
            encoding = "utf-8" if fact["utf8"] else "cp1252" if fact["cp1252"] else "latin-1"
            text = (fact["head"] or b"").decode(encoding, "ignore").removeprefix(BOM)
            options, names, problem = _guess(text), None, None
            try:
                names = next(csv.reader(io.StringIO(text), strict=True, **options), None)
            except csv.Error as error:
                problem = f"invalid CSV: {error}"
            if problem is None:
                if not names or any(not n.strip() for n in names):
                    problem = BAD_HEADER
                elif len(set(names)) != len(names):
                    problem = REPEATED_HEADER
                elif max(map(len, names)) > _NAME_CHARS:
                    problem = LONG_HEADER
            kept = None if problem else names
            rows.append((fact["file_path"], encoding, *options.values(), kept, problem))
        kinds = [
            pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(),
            pa.list_(pa.string()), pa.string(),
        ]
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["file_path", "encoding", "delimiter", "quote", "doubled", "skip", "names",
                   "problem"],
        )


# -- quote states --------------------------------------------------------------------------


def _ends_inside(line: str, inside: bool, options: dict) -> bool:
    """Whether a line that begins in or outside quotes ends inside them.

    After a quote that neither closes a cell nor is doubled the record is malformed; it ends
    with its line.
    """
    quote, delimiter = options["quotechar"], options["delimiter"]
    if not quote or quote not in line:
        return inside
    i = 0
    while True:
        if inside:
            i = line.find(quote, i) + 1
            if not i:
                return True
            if options["doublequote"] and line[i : i + 1] == quote:
                i += 1
                continue
            inside = False
            if line[i : i + 1] != delimiter:
                return False
            i += 1
        while options["skipinitialspace"] and line[i : i + 1] == " ":
            i += 1
        if line[i : i + 1] == quote:
            inside = True
            i += 1
        else:
            i = line.find(delimiter, i) + 1
            if not i:
                return False


_FACTS = ("encoding", "delimiter", "quote", "doubled", "skip")


def _options(facts) -> dict:
    _, delimiter, quote, doubled, skip = facts[:5]
    return {
        "delimiter": delimiter,
        "quotechar": quote,
        "doublequote": doubled,
        "skipinitialspace": skip,
    }


def _text_lines(start: int, lines, encoding: str):
    for i, line in enumerate(lines):
        text = line.decode(encoding)
        yield text.removeprefix(BOM) if start == 0 and i == 0 else text


def _effects(batches):
    """Per split and state at its begin: the state at its end, and records that begin in it."""
    import pyarrow as pa

    for (path, start, *facts), lines in _lines_by_split(batches, *_FACTS):
        options, states, begun = _options(facts), [False, True], [0, 0]
        for text in _text_lines(start, lines, facts[0]):
            for k in (0, 1):
                begun[k] += not states[k]
                states[k] = _ends_inside(text, states[k], options)
        yield pa.RecordBatch.from_pydict(
            {
                "file_path": [path],
                "start": pa.array([start], pa.int64()),
                "outside": [states[0]],
                "within": [states[1]],
                "begun_outside": pa.array([begun[0]], pa.int64()),
                "begun_within": pa.array([begun[1]], pa.int64()),
            }
        )


def _begins(effects: DataFrame) -> DataFrame:
    """``file_path, start, inside, number`` of every split, from what each split does.

    A split either forgets the state it began in, keeps it, or turns it round. So its state is
    what the last forgetful split left, turned round as often as splits since do.
    """
    along = Window.partitionBy("file_path").orderBy("start")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    forgets = F.col("outside") == F.col("within")
    turns = F.when(F.col("outside") & ~F.col("within"), 1).otherwise(0)
    counted = effects.withColumn("turned", F.sum(turns).over(along))
    last = F.last(
        F.when(forgets, F.struct("outside", "turned")), ignorenulls=True
    ).over(before)
    seen = counted.withColumn("last", last).withColumn(
        "so_far", F.coalesce(F.sum(turns).over(before), F.lit(0))
    )
    left = F.coalesce(F.col("last.outside"), F.lit(False))
    odd = (F.col("so_far") - F.coalesce("last.turned", F.lit(0))) % 2 == 1
    known = seen.withColumn("inside", left != odd)
    own = F.when(F.col("inside"), F.col("begun_within")).otherwise(F.col("begun_outside"))
    number = F.coalesce(F.sum(own).over(before), F.lit(0))
    return known.select("file_path", "start", "inside", number.alias("number"))


# -- records -------------------------------------------------------------------------------


def _parsed(text: str, options: dict):
    """(fingerprint, cells, error) of one record's text."""
    import csv
    import hashlib
    import io
    import json

    if len(text) > RECORD_CHARS:
        head = hashlib.sha256(text[:RECORD_CHARS].encode()).hexdigest()
        return head, None, f"CSV record is longer than {RECORD_CHARS} characters"
    try:
        row = next(csv.reader(io.StringIO(text), strict=True, **options), [])
    except csv.Error as error:
        return hashlib.sha256(text.encode()).hexdigest(), None, f"invalid CSV: {error}"
    cells = json.dumps(row, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(cells.encode()).hexdigest(), row, None


def _pieces_batch(rows):
    import pyarrow as pa

    kinds = [
        pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(),
        pa.string(),
    ]
    names = ["file_path", "start", "record_index", "sha", "cells", "error", "body"]
    columns = list(zip(*rows)) or [()] * len(names)
    arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


class _Record:
    """Lines of a record; what goes beyond the limit is not held."""

    def __init__(self) -> None:
        self.lines, self.size = [], 0

    def add(self, text: str) -> None:
        if self.size <= RECORD_CHARS:
            self.lines.append(text[: RECORD_CHARS + 1])
            self.size += len(text) + 1

    def take(self) -> str:
        whole = "\n".join(self.lines)
        self.lines, self.size = [], 0
        return whole


def _records(batches):
    """Records of each split; pieces of a record cut by an edge have no fingerprint.

    A piece that ends a record begun earlier has no number either.
    """
    for (path, start, *facts), lines in _lines_by_split(batches, *_FACTS, "inside", "number"):
        options, (inside, number) = _options(facts), facts[5:]
        index, record, rows, weight = (None if inside else number), _Record(), [], 0
        number -= 1
        for text in _text_lines(start, lines, facts[0]):
            if not inside:
                number += 1
                index = number
            record.add(text)
            inside = _ends_inside(text, inside, options)
            if not inside:
                whole = record.take()
                weight += len(whole)
                if index is None:
                    rows.append((path, start, None, None, None, None, whole))
                elif index > 0:  # the header is number 0
                    rows.append((path, start, index - 1, *_parsed(whole, options), None))
                if len(rows) >= 4096 or weight >= 1 << 24:
                    yield _pieces_batch(rows)
                    rows, weight = [], 0
        if record.lines:
            own = None if index is None else index - 1
            rows.append((path, start, own, None, None, None, record.take()))
        yield _pieces_batch(rows)


def _stitched(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            facts = [r[n] for n in _FACTS]
            done = _parsed("\n".join(r["texts"]), _options(facts))
            rows.append((r["file_path"], 0, r["record_index"], *done, None))
        yield _pieces_batch(rows)


def _beside(
    rows: DataFrame, facts: DataFrame, keys: list[str], row_bytes: int, ordered: bool = True
) -> DataFrame:
    """Rows with the facts of their file or split; lines of a split in order if ``ordered``.

    ``facts`` is a written table. Its size is measured: rows, and the characters of its texts.
    """
    weight = F.lit(row_bytes)
    for name, kind in facts.dtypes:
        if kind in ("string", "array<string>"):
            text = F.col(name) if kind == "string" else F.array_join(name, "")
            weight = weight + F.coalesce(F.length(text), F.lit(0))
    total = facts.agg(F.sum(weight.cast("long")).alias("w")).first().w or 0
    if total <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts), keys)
    if not ordered:
        return rows.join(facts, keys)
    by_split = [F.col("file_path"), F.col("start")]
    joined = rows.withColumn("_at", F.monotonically_increasing_id()).join(facts, keys)
    dealt = joined.repartition(*by_split)
    return dealt.sortWithinPartitions(*by_split, "_at").drop("_at")


def scan_csv(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(records, refused)``: records as ``file_path, record_index, record_sha256, payload,
    parse_error``, and ``file_path, parse_error`` of files that cannot be read at all.

    All values are strings; a bad row is an error record. Blank lines are rows without values
    and keep their number. Nothing that grows with files, splits or rows reaches the driver.
    """
    scan = (
        spark.read.option("lineSep", "\n")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("start"),
            F.col("value").cast("binary").alias("line"),
        )
    )
    facts = (
        scan.mapInArrow(
            _facts_of_splits,
            "file_path string, utf8 boolean, cp1252 boolean, filled boolean, head binary",
        )
        .groupBy("file_path")
        .agg(
            F.bool_and("utf8").alias("utf8"),
            F.bool_and("cp1252").alias("cp1252"),
            F.bool_or("filled").alias("filled"),
            F.max("head").alias("head"),
        )
        .where("filled")
        .drop("filled")
    )
    files = cut_lineage(
        facts.mapInArrow(
            _dialects, f"file_path string, {_DIALECT}, names array<string>, problem string"
        ),
        "csv-files",
    )
    good = files.where("problem IS NULL")
    dialects = good.select("file_path", *_FACTS)
    effects = _beside(scan, dialects, ["file_path"], 64).mapInArrow(
        _effects,
        "file_path string, start long, outside boolean, within boolean, begun_outside long, "
        "begun_within long",
    )
    begins = cut_lineage(_begins(effects).join(dialects, "file_path"), "csv-splits")
    records = _beside(scan, begins, ["file_path", "start"], 96).mapInArrow(_records, _PIECE)
    whole = records.where("sha IS NOT NULL")
    # Of a record cut by edges the first pieces that reach the limit are enough.
    before = Window.partitionBy("file_path").orderBy("start", F.col("record_index").isNotNull())
    size = F.length("body")
    owned = (
        records.where("sha IS NULL")
        .withColumn("record_index", F.last("record_index", ignorenulls=True).over(before))
        .where("record_index >= 0")
        .withColumn(
            "sofar",
            F.sum(size).over(
                Window.partitionBy("file_path", "record_index").orderBy("start")
            ) - size,
        )
        .where(F.col("sofar") <= RECORD_CHARS)
    )
    cut = owned.groupBy("file_path", "record_index").agg(
        F.sort_array(F.collect_list(F.struct("start", "body")))["body"].alias("texts")
    )
    stitched = cut.join(dialects, "file_path").mapInArrow(_stitched, _PIECE)
    columns = ["file_path", "record_index", "sha", "cells", "error"]
    both = whole.select(*columns).unionByName(stitched.select(*columns))
    names = good.select("file_path", "names", F.size("names").alias("n_names"))
    named = _beside(both, cut_lineage(names, "csv-names"), ["file_path"], 64, ordered=False)
    n_cells = F.size("cells")
    fits = n_cells == F.col("n_names")
    misfit = F.concat(
        F.lit("CSV row has "), n_cells, F.lit(" values but expected "), F.col("n_names")
    )
    body = F.to_json(F.when(fits, F.map_from_arrays("names", "cells")))
    payload = F.try_parse_json(body)
    result = named.select(
        "file_path",
        "record_index",
        F.col("sha").alias("record_sha256"),
        payload.alias("payload"),
        F.coalesce("error", F.when(~fits, misfit)).alias("parse_error"),
    )
    return result, files.where("problem IS NOT NULL").select(
        "file_path", F.col("problem").alias("parse_error")
    )
