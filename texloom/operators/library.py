"""The library of jobs: listing, filtering, reuse, projection and idempotent requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texloom.plans import ordered

ACTIVE = ("queued", "downloading", "preparing", "translating", "compiling")
LOG_KEEP = 160


def listing(jobs: DataFrame) -> DataFrame:
    """RK1: newest first, with a place; ties by id."""
    # rank by ranges of time: a global sort, and no window over all rows
    return jobs.orderBy(F.col("created_at").desc(), "id")


def library_filter(jobs: DataFrame, tab: str = "all", query: str = "") -> DataFrame:
    """FP1: a tab (all, done, active) and a part of the name, whatever its case."""
    wanted = {"all": F.lit(True), "done": F.col("status").isin("completed", "partial"), "active": F.col("status").isin(*ACTIVE)}[tab]
    return jobs.where(wanted & F.contains(F.lower("name"), F.lit(query.lower())))


def status_counts(jobs: DataFrame) -> DataFrame:
    """AG4: completed and running jobs."""
    done = F.col("status").isin("completed", "partial")
    return jobs.agg(F.count_if(done).alias("completed"), F.count_if(F.col("status").isin(*ACTIVE)).alias("running"))


def batch_report(results: DataFrame) -> DataFrame:
    """AG3, SK5: processed, remaining and completed of a batch."""
    done = F.col("status").isin("completed", "partial", "failed", "cancelled", "interrupted")
    return results.agg(F.count_if(done).alias("processed"), F.count_if(~done).alias("remaining"), F.count_if(F.col("status") == "completed").alias("completed"))


def coerce_interrupted(jobs: DataFrame) -> DataFrame:
    """SC1: jobs that were active when a process ended are interrupted."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*ACTIVE), "interrupted").otherwise(F.col("status")))


def reuse_rank(status: Column, warned: Column) -> Column:
    """RK2: completed, then partial or completed with warnings, then active; NULL is never reused."""
    rank = F.when(status == "completed", 0).when(status == "partial", 1).when(status.isin(*ACTIVE), 2)
    return F.greatest(rank, F.when(rank.isNotNull() & warned, 1))


def reusable(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """FP5, FP6, RK2: for each request the job that may be used again, or NULL.

    An equi join on the whole source identity, then one aggregate with map-side
    combination; a source that a third of the jobs share is not sorted in one task.
    """
    rank = reuse_rank(F.col("status"), F.size("warnings") > 0)
    usable = jobs.withColumn("_rank", rank).where(F.col("_rank").isNotNull() & (F.col("status").isin(*ACTIVE) | F.col("readable")))
    best = usable.groupBy("kind", "source_id", "language").agg(F.min(F.struct("_rank", (-F.col("created_at")).alias("_age"), "id")).alias("_best"))
    return requests.join(best, ["kind", "source_id", "language"], "left").select(requests["request_id"], F.col("_best.id").alias("job_id"), F.col("_best._rank").alias("rank"))


def replay_or_conflict(requests: DataFrame, bindings: DataFrame) -> DataFrame:
    """JN9, UP2: what an idempotency key is bound to: replay, conflict or new."""
    bound = bindings.groupBy("idempotency_key").agg(F.min(F.struct("ordinal", "job_id", "fingerprint")).alias("_b"))
    joined = requests.join(bound, "idempotency_key", "left")
    outcome = F.when(F.col("_b").isNull(), "new").when(F.col("_b.fingerprint") == F.col("fingerprint"), "replay").otherwise("conflict")
    return joined.select("request_id", outcome.alias("outcome"), F.when(outcome == "replay", F.col("_b.job_id")).alias("job_id"))


def decide(replays: DataFrame, reuse: DataFrame, jobs: DataFrame) -> DataFrame:
    """UP4: replay an explicit key, else reuse a result, else create."""
    status = jobs.select(F.col("id").alias("_id"), "status")
    both = replays.withColumnRenamed("job_id", "_replay").join(reuse.select("request_id", F.col("job_id").alias("_reuse")), "request_id", "left").join(status, F.col("_reuse") == F.col("_id"), "left")
    action = F.when(F.col("outcome") == "conflict", "conflict").when(F.col("outcome") == "replay", "replay").when(F.col("_reuse").isNull(), "create").when(F.col("status").isin(*ACTIVE), "active").otherwise("library")
    return both.select("request_id", action.alias("action"), F.when(action == "replay", F.col("_replay")).when(action.isin("active", "library"), F.col("_reuse")).alias("job_id"))


def public_status(status: Column) -> Column:
    return F.when(status == "partial", "completed_with_warnings").when(status == "interrupted", "needs_retry").otherwise(F.coalesce(status, F.lit("failed")))


def error_code(status: Column, error: Column, message: Column) -> Column:
    """PR3: the class of a failed job's message, by rules in order."""
    text = F.coalesce(F.nullif(error, F.lit("")), F.nullif(message, F.lit("")), F.lit("job failed"))
    has = lambda *xs: F.lit(False) if not xs else F.contains(text, F.lit(xs[0])) | has(*xs[1:])
    code = F.when(has("编译", "XeTeX", "LaTeX"), "COMPILATION_ERROR").when(has("API", "模型", "翻译"), "MODEL_ERROR").when(has("arXiv", "arxiv"), "ARXIV_NOT_FOUND").otherwise("TASK_FAILED")
    return F.when((F.coalesce(error, F.lit("")) != "") | F.coalesce(status == "failed", F.lit(False)), code)


def serialized(jobs: DataFrame) -> DataFrame:
    """PR2: the public form of a job."""
    status = public_status(F.col("status"))
    done, total = F.coalesce("done", F.lit(0)), F.coalesce("total", F.lit(0))
    percent = F.coalesce("progress", F.lit(0))
    percent = F.when((total > 0) & (done >= total) & status.startswith("completed"), F.greatest(percent, F.lit(100))).otherwise(percent)
    quality = F.when((status == "completed_with_warnings") | (F.size("warnings") > 0), "completed_with_warnings").when(status == "completed", "completed")
    return jobs.select("id", status.alias("status"), F.least(F.lit(100), F.greatest(F.lit(0), percent)).alias("percent"), quality.alias("quality"), error_code(F.col("status"), F.col("error"), F.col("message")).alias("error_code"))


def keep_last_logs(logs: Column, keep: int = LOG_KEEP) -> Column:
    """RK6: the last entries of an array."""
    return F.slice(logs, F.greatest(F.lit(1), F.size(logs) - (keep - 1)), F.lit(keep))


def move_notice(jobs: DataFrame, notice: str) -> DataFrame:
    """PR5: a notice goes from the warnings (and original_warnings, where there are any) to the logs, once."""
    fields = [c for c in ("warnings", "original_warnings") if c in jobs.columns]
    has = reduce(lambda a, b: a | b, [F.coalesce(F.array_contains(c, notice), F.lit(False)) for c in fields])
    said = F.exists("logs", lambda x: x["message"].eqNullSafe(F.lit(notice)))
    entry = F.array(F.struct(F.coalesce("updated_at", F.lit(0.0)).alias("time"), F.lit(notice).alias("message")))
    logs = F.when(has & ~F.coalesce(said, F.lit(False)), F.concat(F.coalesce("logs", F.slice(entry, 1, 0)), entry)).otherwise(F.col("logs"))
    return jobs.withColumns({"logs": logs, **{c: F.filter(c, lambda x: ~x.eqNullSafe(F.lit(notice))) for c in fields}})


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """SK2, UP3: the last change of each key replaces its row; max_by combines map-side."""
    columns = current.columns
    rows = current.withColumn("_at", F.lit(None).cast(changes.schema[order].dataType)).unionByName(changes.withColumn("_at", F.col(order)).select(*columns, "_at"))
    packed = F.struct(*columns)
    last = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(packed, F.struct(F.col("_at").isNotNull(), "_at")).alias("_row"))
    return last.select("_row.*")


def insert_new(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """UP2, UP5: rows whose key is not there yet; of repeated keys one is inserted."""
    return incoming.dropDuplicates([key]).join(current.select(key), key, "left_anti")


def submit_once(requests: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """UP7: one request for each key, none for keys in flight."""
    first = requests.groupBy(*keys).agg(F.min("request_id").alias("request_id"))
    return first.join(active.select(*keys).distinct(), keys, "left_anti")


def fold_states(events: DataFrame) -> DataFrame:
    """UP6: the state of each job after its last event that may follow; terminal states hold until a start."""
    state = {"start": "queued", "cancel": "cancelled", "interrupt": "interrupted", "fail": "failed", "finish": "completed"}
    to = F.create_map(*[F.lit(x) for kv in state.items() for x in kv])
    ordered = F.array_sort(F.collect_list(F.struct("at", "event_id", "event")))
    rows = events.where(F.col("event").isin(*state)).groupBy("job_id").agg(ordered.alias("_e"))
    active = lambda s: s == "queued"
    step = lambda s, e: F.when(e["event"] == "start", F.when(active(s), s).otherwise(F.lit("queued"))).when(active(s), F.element_at(to, e["event"])).otherwise(s)
    return rows.select("job_id", F.aggregate("_e", F.lit("interrupted"), step).alias("status"))


def reading_order(annotations: DataFrame) -> DataFrame:
    """RK5: document, first page, top of the first rectangle, creation."""
    first = F.col("anchors")[0]
    return annotations.orderBy("document", first["page"], first["rects"][0]["y"], "created_at", "id")


def reading_places(annotations: DataFrame) -> DataFrame:
    """RK5 as a place from 1 in each document, whatever number of annotations it has: they are sorted over all tasks."""
    first = F.col("anchors")[0]
    keyed = annotations.select("*", first["page"].alias("_page"), first["rects"][0]["y"].alias("_y"), F.lit(1).cast("long").alias("_one"))
    rows = ordered.dealt(keyed, ["document"], ["_page", "_y", "created_at", "id"])
    return ordered.running(rows, ["document"], {"_one": "_n"}).select(*annotations.columns, (F.col("_n") + 1).alias("place"))


def annotation_filter(annotations: DataFrame, document: str | None, query: str) -> DataFrame:
    """FP2: live annotations of a document whose quote or comment holds the query."""
    scope = F.lit(True) if document is None else F.col("document") == document
    return annotations.where(~F.col("deleted") & scope & F.contains(F.lower(F.concat_ws(" ", "quote", "comment")), F.lit(query.lower())))


def get(jobs: DataFrame, identifier) -> DataFrame:
    """FP3: the job of an id; LookupError if there is none."""
    found = jobs.where(F.col("id") == F.lit(identifier))
    if found.isEmpty():
        raise LookupError(f"no job {identifier}")
    return found


def newest_log(logs: DataFrame) -> DataFrame:
    """RK4: (job_id, path): the newest of a job's logs (job_id, path, mtime, priority); of equal times the first by priority."""
    return logs.groupBy("job_id").agg(F.max_by("path", F.struct("mtime", -F.col("priority"))).alias("path"))


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """AG2: (key, values): the distinct values of each key in the order in which they first occur.

    First places are aggregated before anything is gathered, so an array is as long as its distinct values.
    """
    first = rows.groupBy(key, value).agg(F.min(order).alias("_at")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("_v"))
    return first.select(key, F.transform("_v", lambda v: v[value]).alias("values"))


def key_sets(rows: DataFrame, key: str, value: str) -> DataFrame:
    """AG6: (key, values): the set of values of each key, sorted; null values are left out."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def slot_batches(slots: DataFrame, key: str, order: str, most: int = 8) -> DataFrame:
    """RK16: slots with their batch within the key, of most slots each."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return slots.withColumn("batch", F.floor((place - 1) / most))


def drafts(current: DataFrame, puts: DataFrame, clears: DataFrame) -> DataFrame:
    """SK7: drafts (job, id, comment, revision, updated), newest first, after puts and then clears (job, id, comment).

    The last put of a draft replaces it; a clear removes a draft only if its comment is still the one that was saved.
    """
    fields = ("comment", "revision", "updated")
    rows = current.select("job", "id", F.struct(F.lit(0).alias("new"), *fields).alias("_d")).unionByName(puts.select("job", "id", F.struct(F.lit(1).alias("new"), *fields).alias("_d")))
    last = rows.groupBy("job", "id").agg(F.max_by("_d", F.struct("_d.new", "_d.updated", "_d.revision")).alias("_d"))
    last = last.select("job", "id", *(F.col(f"_d.{f}").alias(f) for f in fields))
    return last.join(clears.select("job", "id", "comment").distinct(), ["job", "id", "comment"], "left_anti").orderBy("job", F.desc("updated"), "id").select("job", "id", *fields)


def refreshed_titles(jobs: DataFrame, version: int) -> DataFrame:
    """TX17: the remote title that is cached, else the title of the sources, else the name there is; jobs of this version stay.

    jobs (id, kind, name, title_version, remote_title, local_title); updated_at is not touched.
    """
    due = (F.col("kind") == "arxiv") & ~F.coalesce(F.col("title_version") == version, F.lit(False))
    filled = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    source = F.when(~due, None).when(filled("remote_title").isNotNull(), "arxiv").when(F.col("local_title").isNotNull(), "latex")
    name = F.when(due, F.coalesce(filled("remote_title"), "local_title", "name")).otherwise(F.col("name"))
    return jobs.select("id", name.alias("name"), source.alias("title_source"), F.when(due, F.lit(version)).otherwise(F.col("title_version")).alias("title_version"))
