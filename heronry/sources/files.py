"""Series files, file inventories, filenames, logs and gold sets as DataFrames; sinks for results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: <number>_<prefix>_Anomaly_<name>_<train end>_<begin>_<end>.txt; the name may hold underscores.
FILENAME = r"^(\d+)_(.+?)_Anomaly_(.+)_(\d+)_(\d+)_(\d+)\.(?:txt|csv)$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parse_filename(name: Column) -> Column:
    """Struct (num, name, train_end, begin, end, variant, base_name); NULL where the name doesn't match."""
    got = lambda i: F.regexp_extract(name, FILENAME, i)
    n = got(3)
    variant = F.when(n.startswith("DISTORTED"), "DISTORTED").when(n.startswith("NOISE"), "NOISE").otherwise("plain")
    return F.when(name.rlike(FILENAME), F.struct(got(1).cast("int").alias("num"), n.alias("name"), got(4).cast("long").alias("train_end"), got(5).cast("long").alias("begin"), got(6).cast("long").alias("end"), variant.alias("variant"), F.regexp_replace(n, "^(DISTORTED|NOISE)", "").alias("base_name")))


def _named(raw: DataFrame) -> Column:
    """The name of a row's file: what a folder ``filename=...`` says, as :func:`write_series` leaves it, or the path's last part."""
    return F.col("filename").cast("string") if "filename" in raw.columns else base_name(F.col("_metadata.file_path"))


def _texts(spark: SparkSession, paths: str | Sequence[str], bundled: bool) -> DataFrame:
    """(path, filename, length, content) of files, or of the files that bundles hold (see :func:`write_bundle`)."""
    if bundled:
        raw = spark.read.schema(BUNDLE).parquet(*([paths] if isinstance(paths, str) else paths))
        return raw.select(F.col("_metadata.file_path").alias("path"), "filename", F.length("content").cast("long").alias("length"), "content")
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select("path", _named(raw).alias("filename"), "length", "content")


def read_series(spark: SparkSession, paths: str | Sequence[str], *, strict: bool = True, limit: int | None = None, bundled: bool = False) -> DataFrame:
    """(path, filename, idx, x): values separated by any white space, one file a series.

    An empty file or a token that is no number is an error when it is read; without ``strict`` such files are left out
    (see :func:`inventory` for which). ``limit`` keeps the first files by name. ``bundled``: ``paths`` hold many files each.
    """
    if bundled:
        raw = _texts(spark, paths, True).select("path", "filename", F.decode("content", "UTF-8").alias("value"))
    else:
        raw = spark.read.text(paths, wholetext=True)
        raw = raw.select(F.col("_metadata.file_path").alias("path"), _named(raw).alias("filename"), "value")
    if limit is not None:
        raw = raw.join(raw.select("filename").orderBy("filename").limit(limit), "filename", "left_semi")
    tokens = raw.select("path", "filename", F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "").alias("t"))
    if strict:
        checked = F.when(F.size("t") > 0, F.col("t")).otherwise(F.raise_error(F.format_string("empty series file %s", F.col("path"))))
        return tokens.select("path", "filename", F.posexplode(checked).alias("idx", "v")).select("path", "filename", F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("x"))
    good = tokens.where((F.size("t") > 0) & F.forall("t", lambda v: v.try_cast("double").isNotNull()))
    return good.select("path", "filename", F.posexplode("t").alias("idx", "v")).select("path", "filename", F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("x"))


def inventory(spark: SparkSession, paths: str | Sequence[str], *, bundled: bool = False) -> DataFrame:
    """One row a file, values never cast: bytes, lines, tokens, layout, sha256, and what the filename says."""
    raw = _texts(spark, paths, bundled)
    text = F.decode("content", "UTF-8")
    lines = F.size(F.filter(F.split(text, "\n"), lambda v: F.trim(F.replace(v, F.lit("\r"), F.lit(""))) != ""))
    return raw.select(
        F.col("path"),
        F.col("filename"),
        F.col("length").alias("bytes"),
        lines.cast("long").alias("n_lines"),
        F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")).cast("long").alias("n_tokens"),
        F.contains(text, F.lit("\r\n")).alias("has_crlf"),
        F.contains(text, F.lit("\t")).alias("has_tab"),
        (lines <= 1).alias("single_line"),
        F.sha2("content", 256).alias("sha256"),
        parse_filename(F.col("filename")).alias("meta"),
    )


def with_values(files: DataFrame, series: DataFrame) -> DataFrame:
    """An inventory with what its files hold: (n_values, least, largest); NULL for a file without values."""
    got = series.groupBy("filename").agg(F.count(F.lit(1)).alias("n_values"), F.min("x").alias("least"), F.max("x").alias("largest"))
    return files.join(got, "filename", "left")


def numbering_gaps(files: DataFrame, n: int) -> DataFrame:
    """(num, problem): numbers 1..n that are missing, and those that several files have."""
    spark = files.sparkSession
    have = files.where(F.col("meta").isNotNull()).groupBy(F.col("meta.num").alias("num")).agg(F.count(F.lit(1)).alias("c"))
    want = spark.range(1, n + 1).select(F.col("id").cast("int").alias("num"))
    missing = want.join(have, "num", "left_anti").select("num", F.lit("missing").alias("problem"))
    return missing.union(have.where("c > 1").select("num", F.lit("duplicate").alias("problem")))


def checked_against(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files by name and what the manifest says of them: match, mismatch, file_only, manifest_only."""
    m = manifest.select("filename", F.col("sha256").alias("want_sha"), F.col("n_tokens").alias("want_n"))
    j = files.select("filename", "sha256", "n_tokens", F.lit(1).alias("f")).join(m.withColumn("m", F.lit(1)), "filename", "full")
    status = F.when(F.col("m").isNull(), "file_only").when(F.col("f").isNull(), "manifest_only").when((F.col("sha256") == F.col("want_sha")) & (F.col("n_tokens") == F.col("want_n")), "match").otherwise("mismatch")
    return j.select("filename", status.alias("status"))


def labels_from_name(series: DataFrame) -> DataFrame:
    """Series rows with ``label`` from the 1-based inclusive interval in the filename; 0 everywhere without one."""
    meta = parse_filename(F.col("filename"))
    return series.withColumn("label", F.coalesce(((F.col("idx") >= meta["begin"] - 1) & (F.col("idx") < meta["end"])).cast("int"), F.lit(0)))


def read_labelled_csv(spark: SparkSession, paths: str | Sequence[str], *, bundled: bool = False) -> DataFrame:
    """(filename, idx, x, label) of two-column CSV files with a header."""
    if bundled:
        lines = F.filter(F.split(F.decode("content", "UTF-8"), r"\r?\n"), lambda v: v != "")
        rows = _texts(spark, paths, True).select("filename", F.posexplode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("idx", "v"))
        return rows.select("filename", "idx", F.from_csv("v", "x double, label int").alias("v")).select("filename", "v.x", "v.label", "idx")
    raw = spark.read.schema("x double, label int").csv(paths, header=True)
    order = F.row_number().over(_by_file())
    return raw.select(_named(raw).alias("filename"), F.monotonically_increasing_id().alias("_id"), "x", "label").withColumn("idx", order - 1).drop("_id")


def _by_file():
    from pyspark.sql import Window

    return Window.partitionBy("filename").orderBy("_id")


def one_anomaly(series: DataFrame) -> DataFrame:
    """(filename, segments): labelled series whose label isn't a single run."""
    found = describe_labelled(series)
    return found.where("segments <> 1").select("filename", "segments")


def read_scores(spark: SparkSession, path: str, condition: str) -> DataFrame:
    """(series_id, idx, score) of one condition of a score store; only that partition is read."""
    return spark.read.parquet(path).where(F.col("cond") == condition).drop("cond")


def read_table(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """CSV, plain or gzipped, with a header, read by the schema given and never by guesses; NA is NULL.

    A column of tags such as 1 and 1.0, which are two variants, is read as a string.
    """
    return spark.read.schema(schema).option("enforceSchema", False).csv(paths, header=True, nullValue="NA", mode="FAILFAST")


def load_config(text: str) -> dict:
    """Nested settings from indented ``key: value`` lines: maps, lists in brackets or of "- " lines, numbers, booleans, null, text."""

    def scalar(v: str) -> object:
        v = v.strip()
        if v.startswith("[") and v.endswith("]"):
            return [scalar(x) for x in v[1:-1].split(",") if x.strip()]
        if v[:1] in "\"'" and v[-1:] == v[:1] and len(v) > 1:
            return v[1:-1]
        plain = {"true": True, "false": False, "null": None, "~": None, "": None}
        if v.lower() in plain:
            return plain[v.lower()]
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return v

    root: dict = {}
    stack: list[tuple[int, dict, str | None]] = [(-1, root, None)]
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not bare.strip():
            continue
        depth, item = len(bare) - len(bare.lstrip()), bare.strip()
        if item.startswith("- "):
            _, parent, key = stack[-1]
            if not isinstance(parent.get(key), list):
                parent[key] = []
            parent[key].append(scalar(item[2:]))
            continue
        if ":" not in item:
            raise ValueError(f"no key in {line!r}")
        while stack[-1][0] >= depth:
            stack.pop()
        _, parent, key = stack[-1]
        if key is not None:
            if not isinstance(parent.get(key), dict):
                parent[key] = {}
            parent = parent[key]
        key, _, value = item.partition(":")
        parent[key.strip()] = scalar(value)
        stack.append((depth, parent, key.strip()))
    return root


def settings(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(key, value): a configuration file's settings by dotted key; values of keys that end in _dir are resolved below ``root``."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file

    def walk(d: dict, before: str = ""):
        for k, v in d.items():
            if isinstance(v, dict):
                yield from walk(v, f"{before}{k}.")
            else:
                resolved = f"{root.rstrip('/')}/{v}" if root and k.endswith("_dir") and not str(v).startswith("/") else v
                yield before + k, None if v is None else str(resolved)

    return spark.createDataFrame(list(walk(load_config(text))), "key string, value string")


def is_litter(path: Column) -> Column:
    """Whether a path is a file that systems leave behind: hidden ones, ._ twins, __MACOSX, Thumbs.db, desktop.ini."""
    return path.rlike(r"(^|/)(\.[^/]*|__MACOSX(/.*)?|Thumbs\.db|desktop\.ini)$")


def anchor(paths: DataFrame, name: str) -> DataFrame:
    """(folder): the one folder of that name among ``paths`` (path), litter left out; none or several are an error."""
    found = paths.where(~is_litter(F.col("path"))).select(F.regexp_extract("path", f"^(.*?(?:^|/){name})/", 1).alias("folder")).where("folder <> ''").distinct()
    n = F.count(F.lit(1))
    return found.agg(F.when(n == 1, F.max("folder")).otherwise(F.raise_error(F.format_string("%d folders", n))).alias("folder"))


def describe_labelled(series: DataFrame) -> DataFrame:
    """Per file: length, share of labelled points, number of labelled segments, the shortest, and where the last one ends."""
    from heronry.operators.series import islands

    s = series.withColumnRenamed("filename", "series_id")
    size = s.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("ratio"))
    seg = islands(s, F.col("label") == 1).groupBy("series_id").agg(F.count(F.lit(1)).alias("segments"), F.min(F.col("b") - F.col("a")).alias("min_segment"), F.max("b").alias("last"))
    return size.join(seg, "series_id", "left").withColumn("last_fraction", F.col("last") / F.col("n")).fillna({"segments": 0}).withColumnRenamed("series_id", "filename")


SPAN_SCHEMA = "trace_id string, span_id string, parent_id string, name string, kind string, component string, component_version string, started_at double, ended_at double, duration double, status string, error string, usage struct<input_tokens:bigint,output_tokens:bigint,wall_seconds:double,peak_vram_mb:double>, absorbed_tokens bigint, emitted_tokens bigint, attributes map<string,string>"


def read_spans(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """JSON lines of spans, blank lines skipped; usage fields come out as columns and ``seq`` is the order of starting."""
    raw = spark.read.schema(SPAN_SCHEMA).json(paths)
    flat = raw.select("*", "usage.input_tokens", "usage.output_tokens", "usage.peak_vram_mb").drop("usage")
    return flat.withColumn("seq", F.struct("started_at", "span_id"))


GOLD_SCHEMA = "question_id string, question string, required array<string>, helpful array<string>, forbidden array<string>"


def read_gold(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """JSON lines of a gold set; blank lines and those that begin with # are skipped. A source both required and forbidden is an error."""
    lines = spark.read.text(paths).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    got = lines.select(F.from_json("value", GOLD_SCHEMA, {"mode": "FAILFAST"}).alias("g")).select("g.*")
    empty = F.array().cast("array<string>")
    got = got.withColumns({c: F.coalesce(c, empty) for c in ("required", "helpful", "forbidden")})
    bad = F.arrays_overlap("required", "forbidden")
    return got.withColumn("required", F.when(bad, F.raise_error(F.format_string("%s requires a forbidden source", F.col("question_id"))).cast("array<string>")).otherwise(F.col("required")))


def table_from_markdown(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of a printed table: lines of (value) with cells between bars, header and rule left out."""
    cells = F.transform(F.filter(F.split("value", r"\|"), lambda c: F.trim(c) != ""), lambda c: F.trim(c))
    rows = lines.where(F.col("value").startswith("|") & ~F.col("value").rlike(r"^\|[\s|:-]+\|?$")).select(cells.alias("c")).where((F.size("c") == len(columns)) & (F.get("c", 0) != columns[0]))
    return rows.select(*[F.get("c", i).alias(n) for i, n in enumerate(columns)])


# --- sinks


def write_series(series: DataFrame, path: str) -> None:
    """Series (filename, idx, x) as text, one value a line, one file a series in a folder ``filename=<name>``."""
    rows = series.select("filename", "idx", F.col("x").cast("string").alias("value")).repartition("filename").sortWithinPartitions("filename", "idx")
    rows.select("filename", "value").write.partitionBy("filename").text(path)


BUNDLE = "filename string, content binary"


def write_bundle(lines: DataFrame, path: str, *, header: str | None = None) -> None:
    """Files of lines (filename, idx, value) in bundles: Parquet with a row a file, its name and its bytes.

    For many small files: a folder of its own for each, as :func:`write_series` makes, costs more than what it holds.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("value", F.lit("")).alias("value")))), lambda v: F.concat(v["value"], F.lit("\n"))), "")
    files = lines.groupBy("filename").agg(F.concat(F.lit("" if header is None else f"{header}\n"), text).alias("text"))
    files.select("filename", F.encode("text", "UTF-8").alias("content")).write.parquet(path)


def write_csv(df: DataFrame, path: str, *, digits: int | None = None) -> None:
    """Gzipped CSV with a header and NA for NULL; doubles to so many significant digits."""
    out = df
    if digits is not None:
        out = df.select(*[F.format_string(f"%.{digits}g", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    out.write.mode("overwrite").csv(path, header=True, compression="gzip", nullValue="NA")


def append_jsonl(df: DataFrame, path: str, failures: str | None = None) -> None:
    """Append as JSON lines; rows with ``ok`` false go to ``failures`` where that is given."""
    if failures is None:
        df.write.mode("append").json(path)
    else:
        df.where("ok").write.mode("append").json(path)
        df.where("NOT ok").write.mode("append").json(failures)


def fan_out(df: DataFrame, paths: Mapping[str, str]) -> None:
    """The same rows to several sinks, {path: format}."""
    for path, kind in paths.items():
        df.write.mode("append").format(kind).save(path)


def write_missing(df: DataFrame, path: str, partition: str) -> int:
    """Write only the partitions that aren't there yet, each of them as a whole; returns how many. Safe to run again."""
    from pyspark.errors import AnalysisException

    try:
        done = df.sparkSession.read.parquet(path).select(F.col(partition).cast("string").alias("_p")).distinct()
        df = df.join(done, F.col(partition).cast("string") == F.col("_p"), "left_anti")
    except AnalysisException:
        pass
    new = df.select(partition).distinct().count()
    if new:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return new
