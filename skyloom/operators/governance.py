"""Hashes, fallback tiers, run roll-ups, freshness, licences of models, placement, readiness."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import level_cap, level_label

# Permissive licences, stage order, statuses that count as finished, formats that must be exported.
PERMISSIVE = ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0")
STAGES = ("s0_ingest", "s1_frameqa", "s2_poses", "s3_masking", "s4_depth", "s6_global", "s7_dense", "s8_mesh", "s9_geo", "s10_export", "report")
REQUIRES = {"s1_frameqa": ("s0_ingest",), "s2_poses": ("s1_frameqa",), "s3_masking": ("s2_poses",), "s4_depth": ("s2_poses", "s3_masking"), "s6_global": ("s2_poses",), "s7_dense": ("s4_depth", "s6_global"), "s8_mesh": ("s7_dense",), "s9_geo": ("s7_dense",), "s10_export": ("s8_mesh", "s9_geo"), "report": ("s10_export",)}
FINISHED = ("done", "degraded")
MUST_EXPORT = ("obj", "ply", "las", "geotiff", "gltf", "glb", "fbx")


def combined_hash(hashes: Column) -> Column:
    """Aggregate: SHA-256 of the sorted, joined hashes; empty ones and nulls do not count, repeats do.  For groups that fit one array; see ``combined_hashes``."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(hashes != "", hashes))), ""), 256)


def combined_hashes(df: DataFrame, key: str, hashes: str) -> DataFrame:
    """(key, sha256): ``combined_hash`` of each group.  A group's hashes pass by in sorted batches and are never held together."""
    kind = df.schema[key].dataType.simpleString()
    dealt = df.select(key, F.nullif(F.col(hashes), F.lit("")).alias("h")).repartition(key).sortWithinPartitions(key, "h")

    def digest(batches):
        import pyarrow as pa

        group, state, known = None, hashlib.sha256(), False
        for batch in batches:
            names, found = [], []
            for name, h in zip(batch.column(key).to_pylist(), batch.column("h").to_pylist(), strict=True):
                if known and name != group:
                    names.append(group)
                    found.append(state.hexdigest())
                    state = hashlib.sha256()
                group, known = name, True
                state.update((h or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field(key).type), pa.array(found, pa.string())], names=[key, "sha256"])
            last = batch.schema.field(key).type
        if known:
            yield pa.RecordBatch.from_arrays([pa.array([group], last), pa.array([state.hexdigest()])], names=[key, "sha256"])

    return dealt.mapInArrow(digest, f"{key} {kind}, sha256 string")


def combined_hash_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(sorted(p for p in parts if p)).encode()).hexdigest()


def hash_object(value: object) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def hash_files(spark, path: str) -> DataFrame:
    """(path, length, sha256) of files; the bytes stay on the executors."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def hash_folder(spark, path: str) -> DataFrame:
    """One row: the combined hash of all files.  Names are no part of it, so a renamed file goes unnoticed."""
    return hash_files(spark, path).agg(combined_hash(F.col("sha256")).alias("sha256"))


def choose_tier(tiers: DataFrame, group: str, level: str = "level", name: str = "name", available: str = "available", order: str = "ord", note: str | None = None) -> DataFrame:
    """One row per group: the lowest level available (the first listed of equals), whether it falls back, and why.

    A group without any available tier is an error.
    """
    by = F.struct(F.col(level), F.col(order))
    told = F.col(note) if note else F.lit(None).cast("string")
    best = F.min_by(F.struct(F.col(level).alias("level"), F.col(name).alias("name"), told.alias("note")), F.when(F.col(available), by))
    listed = F.array_sort(F.collect_list(F.when(~F.col(available), F.struct(F.col(order).alias("o"), F.col(level).alias("l"), F.col(name).alias("n")))))
    found = tiers.groupBy(group).agg(best.alias("b"), F.min(level).alias("top"), listed.alias("off"), F.bool_or(available).alias("any"))
    found = found.withColumn("b", F.when(F.col("any"), F.col("b")).otherwise(F.raise_error(F.lit("no tier is available")).cast("struct<level:int,name:string,note:string>")))
    lvl = F.col("b.level")
    skipped = F.transform(F.filter("off", lambda t: t["l"] < lvl), lambda t: F.concat(t["n"], F.lit(" ["), t["l"].cast("string"), F.lit("]")))
    reason = F.concat(F.lit("uses "), F.col("b.name"), F.lit(" ["), lvl.cast("string"), F.lit(", "), level_label(lvl), F.lit("]"), F.when(F.col("b.note") != "", F.concat(F.lit(" because of "), F.col("b.note"))).otherwise(""), F.when(F.size(skipped) > 0, F.concat(F.lit("; not available: "), F.array_join(skipped, ", "))).otherwise(""))
    return found.select(group, lvl.alias("level"), F.col("b.name").alias("name"), (lvl > F.col("top")).alias("degraded"), F.when(lvl > F.col("top"), reason).alias("reason"), level_cap(lvl).alias("confidence_cap"))


def upsert(records: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest row of each key, by version."""
    row = F.struct(*records.columns)
    return records.groupBy(*key).agg(F.max_by(row, version).alias("__row")).select("__row.*")


def run_states(records: DataFrame, run: str, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """State and counts of each run, from one row per stage: failed, else running, else empty, done or partial.

    A run known without any stage (stage is null) is empty.
    """
    has = lambda s: F.bool_or(F.coalesce(F.col("status") == s, F.lit(False)))
    finished = F.col("status").isin(*FINISHED)
    missing = F.count_distinct(F.when(finished & F.col("stage").isin(*stages), F.col("stage")))
    state = F.when(has("failed"), "failed").when(has("running"), "running").when(F.count("stage") == 0, "empty").when(missing == len(stages), "done").otherwise("partial")
    return records.groupBy(run).agg(state.alias("state"), F.count_if(finished).alias("n_done"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count("stage").alias("n_stages"))


def run_report(records: DataFrame, run: str) -> DataFrame:
    """Total wall seconds, counts of stages, failures and fallbacks, and the alignment error of each run."""
    return records.groupBy(run).agg(
        F.sum(F.coalesce("wall", F.lit(0.0))).alias("total_wall"),
        F.count(F.lit(1)).alias("n_stages"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.coalesce(F.col("degraded_reason"), F.lit("")) != "").alias("n_degraded"),
    )


def metric_of(records: DataFrame, run: str, stage: str, metric: str) -> DataFrame:
    """One metric of one stage per run, from a map column of metrics."""
    return records.where(F.col("stage") == stage).groupBy(run).agg(F.max(F.try_element_at("metrics", F.lit(metric))).alias(metric))


def inputs_hashes(current: DataFrame, recorded: DataFrame, run: str) -> DataFrame:
    """(run, stage, inputs_hash) from the outputs of required stages; an absent one counts as ``missing:name``.

    current: run, stage, extra (hash of other inputs or null).
    """
    spark = current.sparkSession
    edges = spark.createDataFrame([(s, r) for s in STAGES for r in (REQUIRES.get(s, ()) or (None,))], "stage string, needs string")
    outs = recorded.select(F.col(run), F.col("stage").alias("needs"), "outputs_hash")
    need = current.join(F.broadcast(edges), "stage").join(outs, [run, "needs"], "left")
    part = F.when(F.col("needs").isNull(), F.lit("")).otherwise(F.coalesce(F.nullif("outputs_hash", F.lit("")), F.concat(F.lit("missing:"), F.col("needs"))))
    extra = need.select(run, "stage", part.alias("h")).unionByName(current.select(run, "stage", F.coalesce("extra", F.lit("")).alias("h")))
    return extra.groupBy(run, "stage").agg(combined_hash(F.col("h")).alias("inputs_hash"))


def freshness(wanted: DataFrame, recorded: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """wanted with fresh: finished before with the same inputs and parameters, and not forced."""
    old = recorded.select(*keys, F.col("status").alias("__s"), F.col("inputs_hash").alias("__i"), F.col("params_hash").alias("__p"))
    fresh = F.col("__s").isin(*FINISHED) & (F.col("inputs_hash") == F.col("__i")) & (F.col("params_hash") == F.col("__p")) & F.lit(not force)
    return wanted.join(old, keys, "left").withColumn("fresh", F.coalesce(fresh, F.lit(False))).drop("__s", "__i", "__p")


def verify(recorded: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """MISSING, OK or MISMATCH of each finished stage; found: keys, outputs_hash, n_missing."""
    now = found.select(*keys, F.col("outputs_hash").alias("__now"), F.coalesce("n_missing", F.lit(0)).alias("__gone"))
    done = recorded.where(F.col("status").isin(*FINISHED)).join(now, keys, "left")
    result = F.when(F.col("__now").isNull() | (F.col("__gone") > 0), "MISSING").when(F.col("__now") == F.coalesce("outputs_hash", F.lit("")), "OK").otherwise("MISMATCH")
    return done.select(*keys, result.alias("result"))


def permitted_models(models: DataFrame, override: bool = False) -> DataFrame:
    """models with permitted: licence on the list and not for reference only, or overridden."""
    return models.withColumn("permitted", (F.col("license").isin(*PERMISSIVE) & ~F.col("reference_only")) | F.lit(override))


def placement(needs: DataFrame, policy: str = "auto", cuda: bool = False, openvino: bool = False, prefer_openvino: bool = True) -> DataFrame:
    """needs (stage, cpu_only, needs_cuda, vram_gb, openvino_ok) with place and backend."""
    heavy = F.col("needs_cuda") | (F.col("vram_gb") > 0)
    place = F.when(F.lit(policy == "force_local"), "local").when(F.lit(policy == "force_cloud"), "cloud-t4").when(F.col("cpu_only"), "local").when(heavy, "cloud-t4").otherwise("local")
    backend = F.when(F.lit(cuda) & heavy, "torch-cuda").when(F.col("openvino_ok") & F.lit(openvino and prefer_openvino), "openvino").otherwise("cpu")
    return needs.withColumn("place", place).withColumn("backend", backend)


def readiness(groups: DataFrame, modules: DataFrame) -> DataFrame:
    """(stage, ready, missing): every group of a stage must have all or any of its modules.

    groups: stage, label, mode (all or any), module; modules: module, available.
    Stages without a module (module is null) are ready.
    """
    have = groups.join(modules, "module", "left").withColumn("ok", F.col("module").isNull() | F.coalesce("available", F.lit(False)))
    each = have.groupBy("stage", "label").agg(F.when(F.first("mode") == "any", F.bool_or("ok")).otherwise(F.bool_and("ok")).alias("ok"), F.array_sort(F.collect_set("module")).alias("m"), F.first("mode").alias("mode"))
    text = F.concat(F.coalesce("label", F.lit("")), F.when(F.col("mode") == "any", F.lit(" lacks any of ")).otherwise(F.lit(" lacks some of ")), F.array_join("m", ", "))
    return each.groupBy("stage").agg(F.bool_and("ok").alias("ready"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), text))), "; ").alias("missing"))


def export_accounting(results: DataFrame, run: str, must: tuple[str, ...] = MUST_EXPORT) -> DataFrame:
    """Counts of formats wanted and written, of must-have formats, and the share of these that were written."""
    required = F.col("format").isin(*must)
    return results.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_wanted"),
        F.count_if("ok").alias("n_ok"),
        F.count_if(required).alias("n_must"),
        F.count_if(required & F.col("ok")).alias("n_must_ok"),
        F.bround(F.count_if(required & F.col("ok")) / F.greatest(F.lit(1), F.count_if(required)), 3).alias("confidence"),
    )


def stages_upto(only: str | None = None, upto: str | None = None, order: tuple[str, ...] = STAGES) -> list[str]:
    """The stages to run: one, or all up to one; unknown names are an error."""
    for name in (only, upto):
        if name is not None and name not in order:
            raise ValueError(f"unknown stage: {name}")
    if only is not None:
        return [only]
    return list(order if upto is None else order[: order.index(upto) + 1])
