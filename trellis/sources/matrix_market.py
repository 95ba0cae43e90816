"""Matrix Market files, coordinate and array: one file, or a folder of parts that follow each other by name.

Triples are (i, j, v) from 1, with the imaginary part as a fourth column ``im`` where entries are complex.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators.canon import dense_index

PART_ENTRIES = 1_000_000


class FormatError(ValueError):
    """A file that is not valid, or of a kind that graphs cannot use."""


@dataclass(frozen=True)
class Kind:
    layout: str
    field: str
    symmetry: str

    def __str__(self) -> str:
        return f"matrix {self.layout} {self.field} {self.symmetry}"

    def valid(self) -> bool:
        if self.layout == "array" and self.field == "pattern":
            return False
        if self.field == "real" and self.symmetry == "hermitian":
            return False
        return not (self.field == "pattern" and self.symmetry in ("hermitian", "skew-symmetric"))


# Words of the banner.
LAYOUTS = ("coordinate", "array")
FIELDS = ("real", "integer", "complex", "pattern")
SYMMETRIES = ("general", "symmetric", "hermitian", "skew-symmetric")


def parse_banner(line: str) -> Kind:
    words = line.strip().split()
    if len(words) != 5:
        raise FormatError("the banner needs five words")
    if words[0] != "%%MatrixMarket":
        raise FormatError("no Matrix Market banner")
    what, layout, field, symmetry = (w.lower() for w in words[1:])
    if what != "matrix" or layout not in LAYOUTS or field not in FIELDS or symmetry not in SYMMETRIES:
        raise FormatError(f"unsupported kind: {line.strip()}")
    kind = Kind(layout, field, symmetry)
    if not kind.valid():
        raise FormatError(f"invalid combination: {kind}")
    return kind


@dataclass(frozen=True)
class Header:
    kind: Kind
    rows: int
    cols: int
    entries: int | None


def parse_header(lines: list[str]) -> Header:
    kind = parse_banner(lines[0] if lines else "")
    for line in lines[1:]:
        if line.startswith("%") or not line.strip():
            continue
        try:
            n = [int(x) for x in line.split()]
        except ValueError as e:
            raise FormatError(f"bad size line: {line!r}") from e
        if len(n) != (3 if kind.layout == "coordinate" else 2):
            raise FormatError(f"bad size line: {line!r}")
        return Header(kind, n[0], n[1], n[2] if kind.layout == "coordinate" else None)
    raise FormatError("no size line")


def read_header(spark: SparkSession, path: str) -> Header:
    """Reads as many leading lines of the first file as the comments need, through Spark's own file access."""
    files, n = sorted(spark.read.text(path).inputFiles()), 64
    while True:
        lines = [r[0] for r in spark.read.text(files[0]).limit(n).collect()] if files else []
        try:
            return parse_header(lines)
        except FormatError as e:
            if str(e) != "no size line" or len(lines) < n:
                raise
            n *= 16


def _array_places(head: Header) -> tuple[Column, Column]:
    """Row and column, from 1, of the entry ``at`` (from 0) of an array, which is stored by columns.

    A symmetric array stores the lower triangle, a skew-symmetric one without its diagonal.
    """
    at, r = F.col("at"), head.rows
    if head.kind.symmetry == "general":
        return (at % r + 1).cast("long"), (F.floor(at / r) + 1).cast("long")
    skew = int(head.kind.symmetry == "skew-symmetric")

    def before(c: Column) -> Column:
        """Entries in the columns before column c (from 0)."""
        return c * (r - skew) - F.floor(c * (c - 1) / 2)

    b = 2 * (r - skew) + 1
    c = F.floor((b - F.sqrt(F.greatest(F.lit(float(b)) * b - 8 * at, F.lit(0.0)))) / 2).cast("long")
    c = F.when(before(c) > at, c - 1).when(before(c + 1) <= at, c + 1).otherwise(c)  # where the root was rounded
    return (at - before(c) + c + skew + 1).cast("long"), (c + 1).cast("long")


def read_matrix(spark: SparkSession, path: str, triangle: str | None = None) -> tuple[Header, DataFrame]:
    """(header, triples as stored); zeros of an array are left out.

    ``triangle`` keeps the entries strictly "lower" or "upper", as graph readers do.
    """
    head = read_header(spark, path)
    lines = spark.read.text(path).select("value", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n")).alias("place"))
    lines = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = lines.agg(F.min("place").alias("first"))  # the size line is the first that is no comment
    words = lines.join(F.broadcast(size)).where("place <> first").select("place", F.split(F.trim("value"), r"\s+").alias("w"))
    if head.kind.layout == "array":
        numbered = dense_index(words.select(F.col("place.file").alias("file"), F.col("place.n").alias("n"), "w"), ["file", "n"], "at")
        i, j = _array_places(head)
        m = numbered.select(i.alias("i"), j.alias("j"), *[F.element_at("w", k + 1).cast("double").alias(c) for k, c in enumerate(_values(head.kind))])
        m = m.where(" or ".join(f"{c} <> 0" for c in _values(head.kind)))
    else:
        value = [F.lit(1.0).alias("v")] if head.kind.field == "pattern" else [F.element_at("w", k + 3).cast("double").alias(c) for k, c in enumerate(_values(head.kind))]
        m = words.select(F.col("w")[0].cast("long").alias("i"), F.col("w")[1].cast("long").alias("j"), *value)
    return head, m if triangle is None else m.where("i > j" if triangle == "lower" else "i < j")


def _values(kind: Kind) -> list[str]:
    return ["v", "im"] if kind.field == "complex" else ["v"]


def expand_symmetry(head: Header, m: DataFrame) -> DataFrame:
    """The whole matrix where the file holds one triangle."""
    if head.kind.symmetry == "general":
        return m
    sign = {"v": 1.0, "im": 1.0}
    if head.kind.symmetry == "skew-symmetric":
        sign = {"v": -1.0, "im": -1.0}
    elif head.kind.symmetry == "hermitian":
        sign = {"v": 1.0, "im": -1.0}
    other = [(F.col(c) * sign[c]).alias(c) for c in m.columns if c in sign]
    return m.unionByName(m.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), *other))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight = 1) of a square matrix, distinct and mirrored if symmetric."""
    head, m = read_matrix(spark, path)
    if head.rows != head.cols:
        raise FormatError("a graph's matrix must be square")
    return expand_symmetry(head, m).select(F.col("i").alias("src"), F.col("j").alias("dst")).distinct().withColumn("weight", F.lit(1.0))


def write_matrix(m: DataFrame, path: str, rows: int, cols: int, kind: Kind | None = None, comment: str = "") -> None:
    """A folder of parts in order: banner, size line, then entries by column and row, PART_ENTRIES or so to a part.

    An array needs every cell of its layout, and an absent one is zero; symmetric kinds take the lower triangle.
    """
    kind = kind or Kind("coordinate", "real", "general")
    if not kind.valid():
        raise FormatError(f"invalid combination: {kind}")
    if kind.layout == "array":
        cells = m.sparkSession.range(rows * cols).select((F.col("id") % rows + 1).alias("i"), (F.floor(F.col("id") / rows) + 1).alias("j"))
        if kind.symmetry != "general":
            cells = cells.where("i > j" if kind.symmetry == "skew-symmetric" else "i >= j")
        m = cells.join(m, ["i", "j"], "left").fillna(0.0, _values(kind))
    n = m.count()
    size = f"{rows} {cols}" if kind.layout == "array" else f"{rows} {cols} {n}"
    top = [f"%%MatrixMarket {kind}", *[f"% {x}" for x in comment.splitlines()], size]
    head = m.sparkSession.createDataFrame([(0, k, 0, x) for k, x in enumerate(top)], "part int, a long, b long, value string")
    value = [] if kind.field == "pattern" else [F.col(c).cast("long") if kind.field == "integer" else F.col(c) for c in _values(kind)]
    place = [] if kind.layout == "array" else ["i", "j"]
    body = m.select(F.lit(1).alias("part"), F.col("j").alias("a"), F.col("i").alias("b"), F.concat_ws(" ", *place, *value).alias("value"))
    parts = -(-(n + len(top)) // PART_ENTRIES)
    head.unionByName(body).repartitionByRange(parts, "part", "a", "b").sortWithinPartitions("part", "a", "b").select("value").write.mode("overwrite").text(path)
