"""From raw files to packed shards, one domain or all of them."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import tables_of, written
from ..functions.text import present
from ..operators import curation, packing, tokens
from ..sources import arrays, layout, text
from ..sources.text import _exists


def preprocess_domain(
    spark: SparkSession, domain: str, raw: str, out: str, length: int = 2048, shard_size: int = 100_000, fraction: float = 0.005, seed: int = 42, filtered: bool = True, text_key: str = "text"
) -> DataFrame:
    """Read, filter, deduplicate, split by file, encode, pack each file and write the shards; one row of metadata.

    Rows read, lines without a text and rows that the filter rejects are counted in the job that writes the documents; the
    seconds of reading, of curating and of packing come with them.
    """
    seconds, began = {}, time.perf_counter()

    def done(phase: str) -> None:
        nonlocal began
        seconds[phase], began = round(time.perf_counter() - began, 1), time.perf_counter()

    read = Observation(f"read-{uuid.uuid4().hex}")
    docs = text.read_documents(spark, raw, text_key, bad="keep").withColumn("place", F.struct("file_rank", "file", "line_no"))
    there = present(F.col("text"))
    rejected = there & (curation.reason(F.col("text")).isNotNull() if filtered else F.lit(False))
    count = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).cast("long")
    docs = written(docs.observe(read, count(there).alias("n_documents"), count(~F.coalesce(there, F.lit(False))).alias("n_bad"), count(rejected).alias("n_rejected")), "documents")
    docs = docs.filter(there)
    done("read_s")
    kept = written(curation.curate(docs, "place", None, filtered=filtered).select("file", "line_no", "text"), "curated")
    done("curate_s")
    split = packing.split_units(kept, "file", fraction, seed)
    coded = split.select("split", "file", "line_no", tokens.encode(F.col("text")).alias("ids"))
    packed = packing.pack(coded, length, "line_no", ("split", "file"))
    order = packing.number_sequences(packed, ("split",), "file")
    arrays.write_shards(packing.shard(order, shard_size), out)
    done("pack_s")
    n_files = docs.agg(F.count_distinct("file")).first()[0]
    meta = packing.packing_metadata(spark.read.parquet(out), length, shard_size, input_dir=raw, output_dir=out, n_input_files=n_files)
    more = read.get | {"n_kept": kept.count(), "elapsed_s": round(sum(seconds.values()), 1)} | seconds
    return meta.withColumn("domain", F.lit(domain)).withColumns({k: F.lit(v) for k, v in more.items()})


MANIFEST = (
    "domain string, error string, input_dir string, output_dir string, tokenizer_profile string, n_input_files long, seq_len long, shard_size long, "
    "train_sequences long, val_sequences long, train_tokens long, val_tokens long, n_documents long, n_bad long, n_rejected long, n_kept long, "
    "read_s double, curate_s double, pack_s double, elapsed_s double, settings string"
)


def preprocess_all(spark: SparkSession, raw_base: str, out_base: str, domains: tuple[str, ...] = curation.DOMAINS, resume: bool = True, **settings) -> DataFrame:
    """Every domain whose folder is there, each with its own text key and filter; the manifest, which is written too.

    A domain that fails leaves a row with ``error`` and the others go on. Each domain's row is written when it is done; with
    ``resume`` a domain whose row is there, of the same settings, is not run again. The driver loops over a fixed list of names.
    """
    names, rows = [c.split()[0] for c in MANIFEST.split(", ")], []
    for domain in layout.present_domains(spark, raw_base, domains):
        own = {"filtered": domain not in curation.UNFILTERED, "text_key": curation.TEXT_KEYS.get(domain, "text")} | settings
        told, place = json.dumps(own, sort_keys=True), f"{out_base}/_done/{domain}"
        before = spark.read.schema(MANIFEST).json(place).first() if resume and _exists(spark, f"{place}/_SUCCESS") else None
        if before and before["settings"] == told:
            rows.append(before.asDict())
            continue
        try:
            with tables_of(spark):
                row = preprocess_domain(spark, domain, f"{raw_base}/{domain}", f"{out_base}/{domain}", **own).first().asDict() | {"settings": told}
            spark.createDataFrame([tuple(row.get(n) for n in names)], MANIFEST).coalesce(1).write.mode("overwrite").json(place)
        except Exception as e:  # noqa: BLE001  whatever is wrong with one domain must not stop the others
            row = {"domain": domain, "error": f"{type(e).__name__}: {e}".splitlines()[0]}
        rows.append(row)
    manifest = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MANIFEST)
    layout.write_manifest(manifest, f"{out_base}/preprocessing_manifest.json")
    return manifest
