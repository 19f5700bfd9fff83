"""FASTA, FASTQ, PHYLIP, Stockholm and tree files as DataFrames, and back. Compressed files (.gz) are read through Spark's codecs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladespark.sources.shared import materialized


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """ord (increasing in file order), name (first word of the header), seq (lines joined, carriage returns and empty lines gone)."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "^>", "").alias("r"))
    parts = F.split("r", "\n", 2)
    name = F.regexp_extract(F.get(parts, 0), r"^(\S*)", 1)
    seq = F.regexp_replace(F.coalesce(F.get(parts, 1), F.lit("")), r"\s", "")
    return records.where(F.trim("r") != "").select("ord", name.alias("name"), seq.alias("seq"))


FASTQ = "path string, start long, kind string, ord long, name string, seq string, lines array<string>"


class _Block:
    """The lines of one split of a FASTQ file, as they come. Records of four lines begin where a line starts with @ and the second after it with +:
    a line of qualities may start with @ too, but two lines after it stands a sequence."""

    def __init__(self, path: str, start: int):
        self.path, self.start, self.lines, self.n, self.found, self.out = path, start, [], 0, False, []

    def row(self, kind: str, name: str | None = None, seq: str | None = None, lines: list[str] | None = None) -> tuple:
        return self.path, self.start, kind, self.start + self.n, name, seq, lines

    def records(self, lines: list[str]) -> Iterator[tuple]:
        for k in range(0, len(lines) - 3, 4):
            head, seq, _, quality = lines[k : k + 4]
            good = head.startswith("@") and len(seq) == len(quality)
            yield self.row("record" if good else "broken", (head[1:].split() or [""])[0], seq)
            self.n += 1

    def add(self, lines: list[str]) -> list[tuple]:
        """Rows that are known so far: lines before the first record, and whole records."""
        self.lines += lines
        out = []
        if not self.found:
            at = 0 if not self.start else next((k for k in range(len(self.lines) - 2) if self.lines[k].startswith("@") and self.lines[k + 2].startswith("+")), None)
            if at is None:
                return out
            self.found = True
            out.append(self.row("head", lines=self.lines[:at]))
            self.lines = self.lines[at:]
        whole = len(self.lines) // 4 * 4
        out += self.records(self.lines[:whole])
        self.lines = self.lines[whole:]
        return out

    def rest(self) -> list[tuple]:
        return [self.row("tail" if self.found else "head", lines=self.lines)]


def read_fastq(spark: SparkSession, path: str, several_lines: bool = False) -> DataFrame:
    """path, ord (increasing in each file), name, seq of FASTQ files. A record whose quality is not as long as its sequence ends its file.

    Files are read in splits, by as many tasks as they have; each finds its first record by itself, and the record that goes over a border is
    put together from the few lines on both sides. Compressed files are one split. several_lines: for sequences of several
    lines; then each file is read by one task."""
    if several_lines:
        return _whole_fastq(spark, path)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.regexp_replace("value", "\r$", "").alias("value"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, columns = None, [c.split()[0] for c in FASTQ.split(", ")]
        for batch in batches:
            out = []
            for (path, start), part in batch.groupby(["path", "start"], sort=False):
                if block is None or (block.path, block.start) != (path, start):
                    out += block.rest() if block else []
                    block = _Block(path, int(start))
                out += block.add(part["value"].tolist())
            yield pd.DataFrame(out, columns=columns)
        if block:
            yield pd.DataFrame(block.rest(), columns=columns)

    rows = materialized(lines.mapInPandas(parse, FASTQ), "fastq")
    edges = rows.where("lines IS NOT NULL").withColumn("t", (F.col("kind") == "tail").cast("int"))
    # a row or two for each split: what follows a tail up to the next is of its record
    at = Window.partitionBy("path").orderBy("start", "t").rowsBetween(Window.unboundedPreceding, 0)
    joined = edges.withColumn("g", F.sum("t").over(at)).where("g > 0").groupBy("path", "g")
    joined = joined.agg(F.min("start").alias("start"), F.min_by("ord", F.struct("start", -F.col("t"))).alias("ord"), F.array_sort(F.collect_list(F.struct("start", (1 - F.col("t")).alias("h"), "lines"))).alias("l"))
    x = F.flatten(F.transform("l", lambda e: e["lines"]))
    # one record, or more where splits are smaller than records
    over = joined.select("path", "ord", x.alias("x")).where(F.size("x") > 3).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.size("x") / 4) - 1)))
    over = over.withColumns({"ord": F.col("ord") + F.col("k"), "x": F.slice("x", (4 * F.col("k") + 1).cast("int"), 4)})
    head, seq, quality = (F.get("x", F.lit(k)) for k in (0, 1, 3))
    good = F.startswith(head, F.lit("@")) & (F.length(seq) == F.length(quality))
    over = over.select("path", "ord", F.when(good, "record").otherwise("broken").alias("kind"), F.regexp_extract(head, r"^@(\S*)", 1).alias("name"), seq.alias("seq"))
    every = rows.where("lines IS NULL").select(*over.columns).unionByName(over)
    ends = every.where("kind = 'broken'").groupBy(F.col("path").alias("__path")).agg(F.min("ord").alias("__end"))
    got = every.where("kind = 'record'").join(ends, F.col("path") == F.col("__path"), "left").where(F.col("__end").isNull() | (F.col("ord") < F.col("__end")))
    return got.select("path", "ord", "name", "seq")


def _whole_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Each file by one task: where records begin is only known from its start if sequences go over several lines."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, text in zip(batch["path"], batch["value"]):
                lines, at, out = text.replace("\r", "").split("\n"), 0, []
                while at < len(lines):
                    if not lines[at].startswith("@"):
                        at += 1
                        continue
                    name, at, seq = (lines[at][1:].split() or [""])[0], at + 1, ""
                    while at < len(lines) and not lines[at].startswith("+"):
                        seq, at = seq + lines[at], at + 1
                    at, quality = at + 1, ""
                    while at < len(lines) and len(quality) < len(seq):
                        quality, at = quality + lines[at], at + 1
                    if len(quality) != len(seq):
                        break
                    out.append((path, len(out), name, seq))
                yield pd.DataFrame(out, columns=["path", "ord", "name", "seq"])

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.mapInPandas(records, "path string, ord long, name string, seq string")


def read_phylip_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Relaxed PHYLIP: names of ten characters, then bases."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "\r", "").alias("v"))
    rows = lines.where(~F.col("v").rlike(r"^\s*\d+\s+\d+\s*$") & (F.trim("v") != ""))
    return rows.select("ord", F.trim(F.substr("v", F.lit(1), F.lit(10))).alias("name"), F.regexp_replace(F.substr("v", F.lit(11)), r"\s", "").alias("seq"))


def read_phylip_matrix(spark: SparkSession, path: str, single: bool = False) -> tuple[DataFrame, DataFrame]:
    """(names: i, name; distances: i, j < i, d). Lower triangles and square matrices; values beyond the triangle are left out.
    single: values go through 32-bit floats. The first line of each file is the count, if it is a number alone. Rows are numbered by their place in a partition and the sizes of earlier partitions."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.input_file_name().alias("file"), F.trim(F.regexp_replace("value", "\r", "")).alias("v"))
    lines = lines.where(F.col("v") != "")
    heads = lines.groupBy("file").agg(F.min_by("v", "at").alias("head"), F.min("at").alias("__at")).where(F.col("head").rlike(r"^\d+$")).select("__at")
    rows = lines.join(heads, F.col("at") == F.col("__at"), "left_anti").select("at", F.split("v", r"\s+").alias("p"))
    rows = rows.repartitionByRange("at").sortWithinPartitions("at")
    rows = materialized(rows.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "matrix-rows")
    # one row for each partition of the file
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("low"))
    starts = sizes.select("part", "low", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start"))
    names = rows.join(starts, "part").select("at", F.get("p", F.lit(0)).alias("name"), (F.col("start") + F.col("row") - F.col("low")).alias("i"))
    cells = rows.select("at", F.posexplode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).alias("j", "x")).join(names, "at").where("j < i")
    value = F.col("x").cast("float").cast("double") if single else F.col("x").cast("double")
    return names.select("i", "name"), cells.select("i", "j", value.alias("d"))


def _quoted(text: str, at: int) -> tuple[str, int]:
    """The quoted name that starts at `at` ('' inside it stands for one quotation mark), and where it ends."""
    out, at = [], at + 1
    while True:
        end = text.index("'", at)
        out.append(text[at:end])
        if text[end + 1 : end + 2] != "'":
            return "".join(out), end + 1
        out.append("'")
        at = end + 2


def parse_newick(text: str) -> list[tuple[int, int | None, str | None, float | None]]:
    """(node, parent, name, length) of a tree; quoted names, comments in square brackets (left out, nested ones too), and labels of inner nodes as
    names; the root's parent is None."""
    rows, stack, node, at = [[0, None, None, None]], [], 0, 0
    text = text.strip()
    while at < len(text) and text[at] != ";":
        c = text[at]
        if c == "(" or c == ",":
            if c == "(":
                stack.append(node)
            if not stack:
                raise ValueError("a comma outside of brackets")
            node = len(rows)
            rows.append([node, stack[-1], None, None])
            at += 1
        elif c == ")":
            if not stack:
                raise ValueError("brackets do not match")
            node, at = stack.pop(), at + 1
        elif c == "'":
            rows[node][2], at = _quoted(text, at)
        elif c == "[":
            deep = 0
            while at < len(text):
                deep += (text[at] == "[") - (text[at] == "]")
                at += 1
                if not deep:
                    break
            if deep:
                raise ValueError("a comment does not end")
        elif c == ":":
            end = at + 1
            while end < len(text) and text[end] not in ",();[":
                end += 1
            if not text[at + 1 : end].strip() and text[end : end + 1] == "[":  # a comment between the colon and the length
                at = text.index("]", end)
                text = text[:at] + ":" + text[at + 1 :]
                continue
            rows[node][3], at = float(text[at + 1 : end]), end
        elif c.isspace():
            at += 1
        else:
            end = at
            while end < len(text) and text[end] not in ",():;'[":
                end += 1
            rows[node][2], at = text[at:end].strip(), end
    if stack:
        raise ValueError("brackets do not match")
    return [tuple(r) for r in rows]


def newick_label(name: str | None) -> str:
    """Names with white space or signs of the format in quotation marks, with those inside doubled; an empty name is a quoted one."""
    if name is None:
        return ""
    return name if name and not any(c in "(),:;'[]" or c.isspace() for c in name) else "'" + name.replace("'", "''") + "'"


def trees_from_newick(trees: DataFrame) -> DataFrame:
    """trees: tree, newick. Rows tree, node, parent, name, len (each tree has to fit one row)."""
    kind = trees.schema["tree"].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(tree, *row) for tree, text in zip(batch["tree"], batch["newick"]) for row in parse_newick(text)]
            frame = pd.DataFrame(out, columns=["tree", "node", "parent", "name", "len"])
            frame["parent"] = frame["parent"].astype("Int64")
            yield frame

    return trees.select("tree", "newick").mapInPandas(parse, f"tree {kind}, node long, parent long, name string, len double")


def newick_of(rows: list[tuple[int, int | None, str | None, float | None]], digits: int = 6) -> str:
    """(node, parent, name, length) -> Newick with `digits` significant digits; children in the order of the rows."""
    below: dict[int | None, list] = {}
    for row in rows:
        below.setdefault(row[1], []).append(row)

    out, todo = [], [(below[None][0], False)]
    while todo:
        item, closing = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        node, _, name, length = item
        end = newick_label(name) + ("" if length is None else f":{length:.{digits}g}")
        if node not in below or closing:
            out.append((")" if closing else "") + end)
            continue
        out.append("(")
        todo.append((item, True))
        for k, child in enumerate(reversed(below[node])):
            if k:
                todo.append((",", False))
            todo.append((child, False))
    return "".join(out) + ";"


def trees_to_newick(rows: DataFrame, digits: int = 6) -> DataFrame:
    """rows: tree, node, parent, name, len -> tree, newick."""
    kind = rows.schema["tree"].dataType.simpleString()

    def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        tuples = [(int(n), None if pd.isna(p) else int(p), None if pd.isna(m) else m, None if pd.isna(x) else float(x)) for n, p, m, x in zip(part["node"], part["parent"], part["name"], part["len"])]
        return pd.DataFrame({"tree": [key[0]], "newick": [newick_of(tuples, digits)]})

    return rows.select("tree", "node", "parent", "name", "len").groupBy("tree").applyInPandas(write, f"tree {kind}, newick string")


def write_fasta(sequences: DataFrame, path: str, width: int = 60) -> None:
    """sequences: name, seq."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), body)).write.text(path)


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, seq of an alignment whose sequences may go on in later blocks; annotations are left out."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim(F.regexp_replace("value", "\r", "")).alias("v"))
    rows = lines.where((F.col("v") != "") & ~F.startswith("v", F.lit("#")) & (F.col("v") != "//")).select("at", F.split("v", r"\s+", 2).alias("p"))
    rows = rows.select("at", F.get("p", F.lit(0)).alias("name"), F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s", "").alias("part"))
    whole = rows.groupBy("name").agg(F.min("at").alias("ord"), F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    return whole.select("ord", "name", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("seq"))


def write_stockholm(sequences: DataFrame, path: str) -> None:
    """sequences: ord, name, seq. One line per sequence, in the order of ord."""
    lines = sequences.select(F.lit(1).alias("k"), "ord", F.concat_ws(" ", F.regexp_replace("name", r"\s", "_"), "seq").alias("value"))
    spark = sequences.sparkSession
    ends = spark.createDataFrame([(0, 0, "# STOCKHOLM 1.0"), (2, 0, "//")], "k int, ord long, value string")
    ends.unionByName(lines).orderBy("k", "ord").select("value").write.text(path)


def write_phylip_sequences(sequences: DataFrame, path: str) -> None:
    """sequences: ord, name, seq of equal lengths. Names of ten characters, shorter ones filled up, longer ones cut."""
    head = sequences.agg(F.concat_ws(" ", F.count("*").cast("string"), F.coalesce(F.max(F.length("seq")), F.lit(0)).cast("string")).alias("value")).select(F.lit(-1).cast("long").alias("ord"), "value")
    head.unionByName(sequences.select("ord", F.concat(F.rpad(F.substr("name", F.lit(1), F.lit(10)), 10, " "), "seq").alias("value"))).orderBy("ord").select("value").write.text(path)


def _square(names: DataFrame, dist: DataFrame) -> DataFrame:
    """i, name, v: the whole row of each sequence, zero on the diagonal."""
    half = dist.where("j < i").select("i", "j", "d")
    both = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")).unionByName(names.select("i", F.col("i").alias("j"), F.lit(0.0).alias("d")))
    rows = both.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "d"))).alias("v"))
    return names.join(rows, "i").select("i", "name", F.transform("v", lambda x: x["d"].cast("string")).alias("v"))


def write_square_matrix(names: DataFrame, dist: DataFrame, path: str) -> None:
    """names: i, name; dist: i, j, d with j < i. All rows whole, after the count of sequences."""
    head = names.agg(F.count("*").cast("string").alias("value")).select(F.lit(-1).cast("long").alias("i"), "value")
    head.unionByName(_square(names, dist).select(F.col("i").cast("long").alias("i"), F.concat_ws("\t", "name", "v").alias("value"))).orderBy("i").select("value").write.text(path)


def write_tab_matrix(names: DataFrame, dist: DataFrame, path: str) -> None:
    """A table with the names above and at the left; the names make up one row."""
    order = names.agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("n")).select(F.lit(-1).cast("long").alias("i"), F.concat_ws("\t", F.lit(""), F.transform("n", lambda x: x["name"])).alias("value"))
    order.unionByName(_square(names, dist).select(F.col("i").cast("long").alias("i"), F.concat_ws("\t", "name", "v").alias("value"))).orderBy("i").select("value").write.text(path)


def excluded(names: DataFrame, dist: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matrix without the sequences named in gone (one column); what is left keeps its numbers."""
    left = names.join(gone.toDF("__gone"), F.col("name") == F.col("__gone"), "left_anti")
    return left, dist.join(left.select("i"), "i", "left_semi").join(left.select(F.col("i").alias("j")), "j", "left_semi")


def of_leaves(sequences: DataFrame, tree: DataFrame) -> DataFrame:
    """The sequences (name, seq) that are leaves of a tree (node, parent, name)."""
    leaves = tree.join(tree.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    return sequences.join(leaves.select("name").distinct(), "name", "left_semi")


def sampled_sequences(sequences: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n sequences, those of the least hash of seed and name."""
    return sequences.orderBy(F.xxhash64(F.lit(seed), "name"), "name").limit(n)


def write_split(sequences: DataFrame, path: str) -> None:
    """A folder name=... for each sequence (name, seq), with its FASTA record in it."""
    sequences.select("name", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.partitionBy("name").text(path)


def concatenated(spark: SparkSession, path: str) -> DataFrame:
    """name, seq: the contigs of each FASTA file put together in their order, under the file's name without its ending."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\s", "").alias("v"))
    lines = lines.where(~F.startswith("v", F.lit(">")))
    whole = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("l"))
    return whole.select(F.regexp_extract("file", r"([^/]+?)(\.[A-Za-z]+)*$", 1).alias("name"), F.array_join(F.transform("l", lambda x: x["v"]), "").alias("seq"))


def numbered(sequences: DataFrame, known: DataFrame) -> DataFrame:
    """sequences: ord, name, seq; known: name, id. Adds id: the known one, and for other names those after the largest known, by ord."""
    both = sequences.join(F.broadcast(known) if known.count() <= 1_000_000 else known, "name", "left")
    new = both.where("id IS NULL").select("name", "ord")
    most = known.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("m")).first()["m"]
    ranged = materialized(new.repartitionByRange("ord").sortWithinPartitions("ord").withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "new-names")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("low"))
    starts = sizes.select("part", "low", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    given = ranged.join(starts, "part").select("ord", (F.lit(most + 1) + F.col("start") + F.col("row") - F.col("low")).alias("__id"))
    return both.join(given, "ord", "left").select(*sequences.columns, F.coalesce("id", "__id").alias("id"))


def write_phylip_matrix(names: DataFrame, dist: DataFrame, path: str) -> None:
    """names: i, name; dist: i, j, d with j < i. A lower triangle, one line per sequence after the count, in part files by i."""
    values = dist.where("j < i").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "d"))).alias("v"))
    lines = names.join(values, "i", "left").select("i", F.concat_ws("\t", "name", F.transform(F.coalesce("v", F.array().cast("array<struct<j:int,d:double>>")), lambda x: x["d"].cast("string"))).alias("value"))
    head = names.agg(F.count("*").cast("string").alias("value")).select(F.lit(-1).alias("i"), "value")
    head.union(lines).orderBy("i").select("value").write.text(path)
