"""Planning and running of recomputes over the whole catalogue.

A plan is one projection over the derived state: every start stage has a fixed chain, so what will
run is a fold over at most seven positions, not a loop over assets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions.arrays import first_match, flag, or_empty
from plateworks.operators.stages import CURRENT, NOT_APPLICABLE, STALE


def metadata_policy() -> Column:
    """Why metadata must not be rebuilt automatically (a human decision or human edits)."""
    md = F.col("md")
    return F.when(md["state"].isin("approved", "rejected"), "HUMAN_DECISION").when(F.size(or_empty(md["edited_fields"])) > 0, "HUMAN_EDITS")


def metadata_reason() -> Column:
    return F.coalesce("metadata_own_reason", "metadata_reason")


def cheapest_repair() -> Column:
    """Re-gate, rules rebuild or full regenerate, by the metadata stage's own reason."""
    stale = F.col("metadata_status") == STALE
    return first_match([(stale & (metadata_reason() == "GATE_POLICY_CHANGED"), "gate"),
                        (stale & (metadata_reason() == "BUILDER_CHANGED"), "rebuild")], "build")


def refusal(start: Column, through: str | None = None) -> Column:
    """Why nothing can be planned from the start stage, or null."""
    def upstream(stage: str) -> Column:
        relaxed = stage in ("creative_review", "publication")
        return F.coalesce(*[flag(~F.col(f"{u}_status").isin(CURRENT, *((NOT_APPLICABLE,) if relaxed and u == "readiness" else ())), u)
                            for u in fixed.RERUN_NEEDS[stage]], F.lit(None).cast("string"))
    bad = first_match([(start == s, upstream(s)) for s in fixed.RERUN_CHAIN], F.lit(None).cast("string"))
    reached = first_match([(start == s, F.lit(through is None or through in chain)) for s, chain in fixed.RERUN_CHAIN.items()], F.lit(False))
    return first_match([
        (F.col("state") == "rejected", "REJECTED"), (F.col("state") == "source_invalid", "SOURCE_INVALID"), (start.isNull(), "NOTHING_STALE"),
        (~start.isin(*fixed.RERUN_CHAIN), "NOT_CONNECTED"), (~reached, "INVALID_THROUGH"),
        (bad.isNotNull(), F.concat(F.lit("UPSTREAM_NOT_CURRENT:"), bad))], F.lit(None).cast("string"))


def plan(rows: DataFrame, start: str | None = None, through: str | None = None) -> DataFrame:
    """Derived state (source verified) -> asset_id, start, pos, stage, action, why; refusals have pos -1."""
    rows = rows.withColumn("start", F.lit(start) if start else F.col("reprocess_from")).withColumn("policy", metadata_policy())
    rows = rows.withColumn("refused", refusal(F.col("start"), through))
    order = fixed.RERUN_CHAIN["normalize"] + ("creative_review", "publication")
    in_chain = {name: F.col("start").isin(*[s for s, chain in fixed.RERUN_CHAIN.items()
                                            if name in (chain if through not in chain else chain[:chain.index(through) + 1])]) for name in order}
    rows = rows.withColumn("stopped", F.lit(False))
    for name in order:  # chains are sub-sequences of one order, so one pass serves every start stage
        status, reason = F.col(f"{name}_status"), F.col(f"{name}_reason")
        active = F.col("refused").isNull() & in_chain[name] & ~F.col("stopped")
        before = order[:order.index(name)]
        rerun = F.coalesce(*[flag(F.col(f"run_{d}"), d) for d in fixed.DEPENDS_ON[name] if d in before], F.lit(None).cast("string"))
        metadata_runs = F.col("run_metadata") if "metadata" in before else F.lit(False)
        unneeded = (status == NOT_APPLICABLE) & ~metadata_runs if name in ("readiness", "creative_review", "publication") else F.lit(False)
        forced = metadata_runs if name == "readiness" else F.lit(False)
        idle = (status == CURRENT) & rerun.isNull()
        stop = F.col("policy").isNotNull() if name == "metadata" else F.lit(False)
        action = first_match([(~active, F.lit(None).cast("string")), (unneeded, "skip"), (forced, "run"), (idle, "skip"), (stop, "stop")],
                             "derive" if name == "view" else "run")
        why = first_match([(unneeded, F.concat(F.lit("not_applicable:"), reason)), (forced, "UPSTREAM_RERUN:metadata (if metadata stays approved)"),
                           (idle, "current"), (stop, F.col("policy")), (status != CURRENT, reason)], F.concat(F.lit("UPSTREAM_RERUN:"), rerun))
        rows = rows.withColumn("step", F.struct(F.lit(name).alias("stage"), action.alias("action"), why.alias("why")))
        rows = rows.withColumns({f"step_{name}": F.when(F.col("step.action").isNotNull(), F.col("step")),
                                 f"run_{name}": F.coalesce(F.col("step.action").isin("run", "derive"), F.lit(False)),
                                 "stopped": F.col("stopped") | F.col("step.action").eqNullSafe(F.lit("stop"))})
    steps = F.filter(F.array(*[F.col(f"step_{n}") for n in order]), lambda s: s.isNotNull())
    refused = F.array(F.struct(F.lit(None).cast("string").alias("stage"), F.lit("refused").alias("action"), F.col("refused").alias("why")))
    rows = rows.select("asset_id", "start", F.col("refused").isNotNull().alias("is_refused"), F.when(F.col("refused").isNotNull(), refused).otherwise(steps).alias("steps"))
    return rows.select("asset_id", "start", "is_refused", F.posexplode_outer("steps").alias("pos", "step")).select(
        "asset_id", "start", F.when(F.col("is_refused"), -1).otherwise(F.col("pos")).alias("pos"), "step.stage", "step.action", "step.why")


def state_lists(rows: DataFrame, collected: DataFrame) -> DataFrame:
    """Approved items per platform with export status and batch; blocked items with reasons; rejected items."""
    nothing = F.lit(None).cast("string")
    files = F.array(*[F.struct(F.lit(p).alias("platform"), F.col(f"{p}_file.status").alias("status"), F.col(f"export_{p}.sha256").alias("sha256")) for p in fixed.PLATFORMS])
    approved = (rows.filter(F.col("state").isin("publication_approved", "ready_for_export"))
                .select("asset_id", "state", F.inline(F.filter(files, lambda f: F.array_contains("approved_for", f["platform"])))))
    batches = collected.select("asset_id", "platform", "sha256", "batch", F.lit("ready_for_export").alias("status"))
    approved = approved.join(batches, ["asset_id", "platform", "sha256", "status"], "left").select(
        "asset_id", "state", "platform", "status", "batch", nothing.alias("detail"))
    no_batch = F.lit(None).cast("bigint").alias("batch")
    blocked = rows.filter(F.col("state") == "blocked").select(
        "asset_id", "state", nothing.alias("platform"), F.when(F.array_contains("reasons", "MODEL_RELEASE_REQUIRED"), "attestable").otherwise("blocked").alias("status"),
        no_batch, F.array_join("reasons", ",").alias("detail"))
    rejected = rows.filter(F.col("state") == "rejected").select(
        "asset_id", "state", nothing.alias("platform"), F.substring("md.review.decided_at", 1, 10).alias("status"), no_batch, F.col("md.review.reason").alias("detail"))
    return approved.unionByName(blocked).unionByName(rejected)
