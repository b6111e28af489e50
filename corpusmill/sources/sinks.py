"""Exports: trainer forms, Arrow files, and a sealed bundle that can be verified by reading it again."""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapping import alpaca, assemble_prompt, reject_code, sharegpt

#: Rows whose digests one group gathers; groups are then bounded whatever the table's size.
FINGERPRINT_ROWS = 65_536


def _from_digests(digests: DataFrame) -> DataFrame:
    group = F.floor(F.col("ordinal") / FINGERPRINT_ROWS).alias("g")
    ordered = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value]), "")
    inner = digests.select("partition", group, "ordinal", F.col("payload_sha256").alias("d")).groupBy("partition", "g").agg(F.sha2(ordered("ordinal", "d"), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    inner = inner.withColumn("h", F.floor(F.col("g") / FINGERPRINT_ROWS)).groupBy("partition", "h").agg(F.sha2(ordered("g", "d"), 256).alias("d"), F.sum("n").alias("n")).withColumnRenamed("h", "g")
    return inner.groupBy("partition").agg(F.sum("n").alias("rows"), F.sha2(ordered("g", "d"), 256).alias("fingerprint"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """partition, rows, fingerprint for rows (partition, ordinal, payload): a digest of all payloads in order.

    Digests are gathered in groups of 65,536 consecutive ordinals, those of the groups likewise, and theirs after that.
    """
    return _from_digests(rows.select("partition", "ordinal", F.sha2("payload", 256).alias("payload_sha256")))


def write_bundle(rows: DataFrame, path: str) -> None:
    """rows (partition, ordinal, record_id, payload) as JSON lines by partition, provenance and a manifest; refuses to replace.

    The manifest is written last: a folder without one is an unfinished bundle.
    """
    placed = rows.select("partition", "ordinal", "record_id", "payload")
    placed.select("partition", "payload").write.mode("error").partitionBy("partition").text(f"{path}/rows")
    placed.select("partition", "ordinal", "record_id", F.sha2("payload", 256).alias("payload_sha256")).write.mode("error").parquet(f"{path}/provenance")
    fingerprint(placed).coalesce(1).write.mode("error").json(f"{path}/manifest")


def verify_bundle(spark: SparkSession, path: str) -> DataFrame:
    """partition, rows, intact: whether the payloads read back are those of the provenance, and both those of the manifest."""
    manifest = spark.read.schema("partition string, rows long, fingerprint string").json(f"{path}/manifest")
    provenance = spark.read.parquet(f"{path}/provenance")
    # payloads are matched by digest and count, as the order of lines in a folder is not kept
    found = spark.read.text(f"{path}/rows").select("partition", F.sha2("value", 256).alias("payload_sha256"))
    count = lambda df, n: df.groupBy("partition", "payload_sha256").agg(F.count(F.lit(1)).alias(n))
    both = count(found, "a").join(count(provenance, "b"), ["partition", "payload_sha256"], "full")
    wrong = both.groupBy("partition").agg(F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")).alias("wrong"))
    again = _from_digests(provenance)
    return manifest.join(again.select("partition", F.col("fingerprint").alias("f"), F.col("rows").alias("r")), "partition", "full").join(wrong, "partition", "full").select(
        "partition", "rows", (F.col("fingerprint").eqNullSafe(F.col("f")) & F.col("rows").eqNullSafe(F.col("r")) & (F.coalesce("wrong", F.lit(1)) == 0)).alias("intact")
    )


def write_arrow(rows: DataFrame, path: str, stream: bool = False) -> None:
    """One uncompressed Arrow IPC file (or stream) for each task, in a folder that all executors reach.

    A task writes under a name of its own attempt and renames it at the end, so a task that is run again replaces its file whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, writer, count = TaskContext.get(), None, 0
        name = f"{path}/part-{context.partitionId():05d}.arrow"
        for batch in batches:
            if writer is None:
                os.makedirs(path, exist_ok=True)
                writer = (pa.ipc.new_stream if stream else pa.ipc.new_file)(f"{name}.{context.taskAttemptId()}", batch.schema)
            writer.write_batch(batch)
            count += batch.num_rows
        if writer is not None:
            writer.close()
            os.replace(f"{name}.{context.taskAttemptId()}", name)
        yield pa.RecordBatch.from_pydict({"rows": [count]})

    if os.path.exists(path):
        raise FileExistsError(path)
    rows.mapInArrow(run, "rows long").agg(F.sum("rows")).collect()


#: Trainer forms: how (prompt, completion) rows are turned, what the partitions are called, what a side file says.
PROFILES = {
    "trl": (lambda r: r, {"train": "train", "evaluation": "test"}),
    "mlx": (lambda r: r, {"train": "train", "evaluation": "valid"}),
    "axolotl": (alpaca, {"train": "train", "evaluation": "evaluation"}),
    "llama-factory": (sharegpt, {"train": "train", "evaluation": "evaluation"}),
}


def write_profile(rows: DataFrame, path: str, profile: str) -> None:
    """rows (partition, prompt, completion) in a trainer's form: a folder of JSON lines for each partition, and dataset_info.json."""
    form, names = PROFILES[profile]
    for partition, name in names.items():
        form(rows.filter(F.col("partition") == partition).select("prompt", "completion")).write.mode("error").json(f"{path}/{name}")
    columns = form(rows.select("prompt", "completion")).columns
    info = {name: {"path": name, "columns": columns, "format": profile} for name in names.values()}
    spark = rows.sparkSession
    spark.createDataFrame([(json.dumps(info, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(f"{path}/dataset_info")


def write_instructions(rows: DataFrame, path: str) -> None:
    """rows (partition, instruction, input, output) as prompt and completion, split by partition."""
    assemble_prompt(rows).write.mode("error").partitionBy("partition").json(path)


def write_rejections(rows: DataFrame, payload: str, fields: dict[str, str], path: str, row_schema: str | None = None, membership: str = "replaced") -> None:
    """JSON lines of rejected rows (row_index, and the payload's digest rather than the payload) with their reason codes; refuses to replace."""
    code = reject_code(F.col(payload), fields, membership, row_schema)
    rows.select("row_index", code.alias("reason_code"), F.sha2(payload, 256).alias("payload_sha256")).filter("reason_code is not null").write.mode("error").json(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, the path, and copying of bytes, as the JVM has them."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def _append(spark: SparkSession, out, folder: str) -> None:
    """Appends the files of a folder in order to a stream, without the separator at the very end; each is deleted once it is copied."""
    files, at, jvm = _files(spark, folder)
    parts = [(f.getPath(), f.getLen()) for f in files.listStatus(at) if f.getPath().getName().startswith("part-") and f.getLen()]
    parts.sort(key=lambda p: (int(p[0].getName().split("-")[1]), p[0].getName()))
    for k, (part, size) in enumerate(parts):
        source = files.open(part)
        try:
            jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size - (len(SEPARATOR) if k == len(parts) - 1 else 0))
        finally:
            source.close()
        files.delete(part, False)


#: What stands between two elements of a list of `write_json`: each has a line of its own.
SEPARATOR = ",\n"


def write_json(rows: DataFrame, path: str) -> None:
    """rows (partition, ordinal, record_id, payload) as a file with one JSON document: payloads by partition in order, and their provenance; refuses to replace.

    Tasks sort and write the elements, a line each; the finished files are then appended to one as bytes, so nothing holds more
    than a line. Line ends inside a payload, which can only stand between its tokens, become blanks. `rows` is read several times.
    """
    spark = rows.sparkSession
    files, target, _ = _files(spark, path)
    if files.exists(target):
        raise FileExistsError(path)
    value = F.coalesce("payload", F.lit("null"))
    lists = {
        "provenance": F.to_json(F.struct(F.sha2("payload", 256).alias("payload_sha256"), F.col("record_id").cast("string").alias("record_id"))),
        "splits": F.translate(value, "\n\r", "  "),
    }
    found = [r[0] for r in rows.select("partition").distinct().collect()]  # train and evaluation, as a rule
    if None in found:
        raise ValueError("a row without a partition")
    names = sorted(found)
    files, unfinished, _ = _files(spark, f"{path}.part")
    out = files.create(unfinished, False)
    try:
        put = lambda text: out.write(text.encode())
        for k, (section, line) in enumerate(lists.items()):
            put(f'{"," if k else "{"}"{section}":{{\n')
            for n, name in enumerate(names):
                folder = f"{path}.parts/{section}-{n}"
                some = rows.filter(F.col("partition") == name)
                # digests order rows of one place: keys are sampled to the driver, so texts are none
                placed = some.select("ordinal", "record_id", F.sha2("payload", 256).alias("d"), line.alias("value")).orderBy("ordinal", "record_id", "d")
                placed.select("value").write.mode("error").option("lineSep", SEPARATOR).text(folder)
                put(f'{"," if n else ""}{json.dumps(name)}:[\n')
                _append(spark, out, folder)
                put("\n]\n")
            put("}")
        put("}\n")
    finally:
        out.close()
    if not files.rename(unfinished, target):
        raise FileExistsError(path)
    files.delete(_files(spark, f"{path}.parts")[1], True)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """partition, payload of a document of `write_json`, read in splits: the last line that opens a list before a payload names its partition."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")).alias("place"), "value")
    # no element looks like these: a key and a colon outside an object
    opens = F.col("value").rlike(r'^,?"[^"\\]*+(?:\\.[^"\\]*+)*+":\[$')
    section = F.regexp_extract("value", r'^[{},]*"(provenance|splits)":\{$', 1)
    name = F.get(F.from_json(F.concat(F.lit("["), F.regexp_replace("value", r"^,|:\[$", ""), F.lit("]")), "array<string>"), F.lit(0))
    marks = lines.filter(opens | (section != "") | (F.col("value") == "]")).select("place", F.when(opens, "list").otherwise(section).alias("kind"), F.when(opens, name).alias("partition"))
    marks = marks.agg(F.array_sort(F.collect_list(F.struct("place", "kind", "partition"))).alias("marks"))  # two for each partition and list
    before = lambda kinds: F.filter("marks", lambda m: (m["place"] < F.col("place")) & m["kind"].isin(*kinds))
    last = lambda kinds: F.try_element_at(before(kinds), F.lit(-1))
    inside = lines.crossJoin(F.broadcast(marks)).filter(~opens & (section == "") & ~F.col("value").isin("]", "}", "}}", ""))
    rows = inside.select(last(("provenance", "splits"))["kind"].alias("section"), last(("list",))["partition"].alias("partition"), F.regexp_replace("value", r",$", "").alias("payload"))
    return rows.filter("section = 'splits'").select("partition", "payload")


def write_dataset_folder(rows: DataFrame, path: str) -> None:
    """rows (partition, ...) as a folder for dataset libraries: dataset_dict.json, and for each partition Arrow files and their description.

    The description is written last; a partition without it is unfinished.
    """
    names = sorted(r[0] for r in rows.select("partition").distinct().limit(1000).collect())  # train and evaluation, as a rule
    for name in names:
        part = rows.filter(F.col("partition") == name).drop("partition")
        write_arrow(part, f"{path}/{name}", stream=True)
        files = sorted(f for f in os.listdir(f"{path}/{name}") if f.endswith(".arrow"))
        info = {"features": {f.name: {"dtype": f.dataType.simpleString(), "_type": "Value"} for f in part.schema.fields}, "splits": {name: {"name": name, "num_examples": part.count()}}}
        state = {"_data_files": [{"filename": f} for f in files], "_split": name}
        for target, body in (("dataset_info", info), ("state", state)):
            with open(f"{path}/{name}/{target}.json", "w", encoding="utf-8") as f:
                json.dump(body, f, sort_keys=True)
    with open(f"{path}/dataset_dict.json", "w", encoding="utf-8") as f:
        json.dump({"splits": names}, f)


def handoff(rows: DataFrame) -> str:
    """The descriptor by which a consumer checks what it gets: rows and fingerprint of each partition, as canonical JSON."""
    parts = {r["partition"]: {"fingerprint": r["fingerprint"], "rows": r["rows"]} for r in fingerprint(rows).limit(1000).collect()}
    return json.dumps({"partitions": parts, "version": 1}, sort_keys=True, separators=(",", ":"))


def consumed(rows: DataFrame, descriptor: str) -> bool:
    """Whether the rows that a consumer read are those of the descriptor."""
    return handoff(rows) == descriptor


def verify_zip(target: str, sha256: str | None = None) -> list[str]:
    """What is wrong with a zip of `zip_folder`: another digest, names out of order or unsafe, compression, times, damaged files; nothing if all is well."""
    import hashlib

    wrong = []
    if sha256 is not None:
        digest = hashlib.sha256()
        with open(target, "rb") as f:
            while part := f.read(1 << 20):
                digest.update(part)
        if digest.hexdigest() != sha256:
            wrong.append("digest")
    try:
        with zipfile.ZipFile(target) as z:
            infos = z.infolist()
            names = [i.filename for i in infos]
            if names != sorted(set(names)):
                wrong.append("order")
            wrong += [f"name:{n}" for n in names if n.startswith("/") or ".." in n.split("/") or "\\" in n]
            wrong += [f"form:{i.filename}" for i in infos if i.compress_type != zipfile.ZIP_STORED or i.date_time != (1980, 1, 1, 0, 0, 0)]
            if (bad := z.testzip()) is not None:
                wrong.append(f"damaged:{bad}")
    except zipfile.BadZipFile:
        wrong.append("not-a-zip")
    return wrong


#: What each export takes, for a look before it is made: the columns it reads.
EXPORTS = {
    "bundle": ("partition", "ordinal", "record_id", "payload"),
    "json": ("partition", "ordinal", "record_id", "payload"),
    "dataset-folder": ("partition",),
    "arrow": (),
    **{name: ("partition", "prompt", "completion") for name in PROFILES},
}


def export_plan(rows: DataFrame, export: str) -> dict:
    """What an export would read and write, without writing: its columns, and rows of each partition; a missing column is an error."""
    missing = [c for c in EXPORTS[export] if c not in rows.columns]
    if missing:
        raise ValueError(f"{export} needs {missing}")
    counts = {r["partition"]: r["count"] for r in rows.groupBy("partition").count().limit(1000).collect()} if "partition" in rows.columns else {"": rows.count()}
    return {"export": export, "columns": list(EXPORTS[export] or rows.columns), "rows": dict(sorted(counts.items()))}


def zip_folder(folder: str, target: str) -> None:
    """A finished local export as a zip that is equal byte by byte for equal files: sorted names, fixed times, no compression."""
    if os.path.exists(target):
        raise FileExistsError(target)
    names = sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, files in os.walk(folder) for f in files)
    with zipfile.ZipFile(f"{target}.part", "w", zipfile.ZIP_STORED) as z:
        for name in names:
            with open(os.path.join(folder, name), "rb") as source, z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as out:
                while part := source.read(1 << 20):
                    out.write(part)
    os.rename(f"{target}.part", target)
