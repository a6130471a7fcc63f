"""Keeping an index in step with a changing corpus: pure functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import folder_covers, stem

# Order of kinds in the queue, bytes of one unit of work, attempts of a job, weight of a new rate.
PRIORITY = {"markdown": 0, "code": 1, "pdf": 2, "image": 3, "audio": 4}
UNIT_BYTES = {"markdown": 4 << 10, "code": 4 << 10, "pdf": 80 << 10, "audio": 16 << 10, "video": 256 << 10}
MAX_ATTEMPTS, ALPHA = 3, 0.2
# Seconds a unit before any was measured.
USUAL_RATES = {"markdown": 0.3, "code": 0.3, "pdf": 1.0, "image": 1.0, "audio": 0.05, "video": 0.5}
#: Note of an image that is indexed with the document that shows it.
LINKED = "indexed with the document that shows it"


def snapshot_diff(known: DataFrame, found: DataFrame) -> DataFrame:
    """path, change: `known` has path, size, mtime, sha256, status; `found` path, size, mtime, sha256.

    unchanged (size and time), touched (other time, same content), changed, new, revived (was stale, same content), gone.
    """
    k, f = known.alias("k"), found.alias("f")
    same = (F.col("k.size") == F.col("f.size")) & (F.col("k.mtime") == F.col("f.mtime")) & F.col("k.sha256").isNotNull()
    change = (
        F.when(F.col("k.path").isNull(), "new")
        .when(F.col("f.path").isNull(), "gone")
        .when((same | (F.col("k.sha256") == F.col("f.sha256"))) & (F.col("k.status") == "stale"), "revived")
        .when(same, "unchanged")
        .when(F.col("k.sha256") == F.col("f.sha256"), "touched")
        .otherwise("changed")
    )
    return k.join(f, F.col("k.path") == F.col("f.path"), "full").select(F.coalesce("k.path", "f.path").alias("path"), change.alias("change"))


def numbered(parts: DataFrame, order: str, after: int, name: str) -> DataFrame:
    """`parts` with `name` for its _part: numbers from `after` + 1 on, in the order of _part and `order`.

    `parts` is a written table whose _part is the task that a range of `order` was dealt to; so no window holds all rows, and the
    one over the parts themselves has a row for each of them.
    """
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", (F.coalesce(F.sum("_size").over(upto), F.lit(0)) + after).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.join(starts, "_part").withColumn(name, (F.col("_start") + own).cast("long")).drop("_part", "_start")


def really_gone(gone: DataFrame, keep: list[str], there: DataFrame) -> DataFrame:
    """`gone` (path, status) without the documents of folders that are kept, while their files are there and they aren't stale.

    `keep` are the configured folders, a handful.
    """
    if not keep:
        return gone
    covered = F.lit(False)
    for folder in keep:
        covered = covered | folder_covers(F.lit(folder), F.col("path"))
    held = there.select(F.col("path").alias("_p")).distinct().withColumn("_t", F.lit(True))
    met = gone.join(held, F.col("path") == F.col("_p"), "left")
    return met.where(~(covered & (F.col("status") != "stale") & F.coalesce("_t", F.lit(False)))).drop("_p", "_t")


def moves(gone: DataFrame, new: DataFrame) -> DataFrame:
    """old_path, new_path: the n-th gone and the n-th new path of equal content and kind are one moved document."""
    nth = Window.partitionBy("sha256", "kind").orderBy("path")
    g = gone.withColumn("_n", F.row_number().over(nth)).withColumnRenamed("path", "old_path")
    n = new.withColumn("_n", F.row_number().over(nth)).withColumnRenamed("path", "new_path")
    return g.join(n, ["sha256", "kind", "_n"]).select("old_path", "new_path")


def revived_status(chunk_count: Column, embed_id: Column) -> Column:
    return F.when((chunk_count > 0) & (F.coalesce(embed_id, F.lit("")) != ""), "done").otherwise("pending")


def pairs(texts: DataFrame, pdfs: DataFrame) -> DataFrame:
    """md_path, pdf_path, how: transcriptions and their PDFs.

    `texts` has path, source (a path from the front matter, or null) and mirror (the path a mirrored folder gives); `pdfs`
    has path. Front matter goes first and decides its text even where its PDF is missing or taken; then mirrors; then names
    that only one PDF has. Each PDF is taken once, by the first text in path order.
    """

    def claim(wanted: DataFrame, taken: DataFrame | None, how: str) -> DataFrame:
        free = wanted if taken is None else wanted.join(taken.select("pdf_path"), "pdf_path", "left_anti")
        first = Window.partitionBy("pdf_path").orderBy("md_path")
        return free.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("md_path", "pdf_path", F.lit(how).alias("how"))

    all_pdf = pdfs.select(F.col("path").alias("pdf_path"))
    md = texts.select(F.col("path").alias("md_path"), "source", "mirror")
    named = claim(md.where("source is not null").join(all_pdf, F.col("source") == F.col("pdf_path")), None, "source")
    open_ = md.where("source is null")
    mirrored = claim(open_.join(all_pdf, F.col("mirror") == F.col("pdf_path")), named, "mirror")
    taken = named.union(mirrored)
    still = open_.join(mirrored.select("md_path"), "md_path", "left_anti").withColumn("_stem", stem(F.col("md_path")))
    single = all_pdf.withColumn("_stem", stem(F.col("pdf_path"))).groupBy("_stem").agg(F.min("pdf_path").alias("pdf_path"), F.count("*").alias("_k")).where("_k = 1")
    return taken.union(claim(still.join(single, "_stem"), taken, "name"))


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after the documents of `new` have got new ones."""
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


def dropped_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """child_path of links that went with no other parent left: these images are indexed by themselves again."""
    return old.join(new, ["parent_id", "child_path"], "left_anti").select("child_path").distinct().join(new.select("child_path").distinct(), "child_path", "left_anti")


def replace_links(docs: DataFrame, old: DataFrame, new: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and documents after the documents of `parents` (document_id) have been read again.

    `docs` has path, status, chunk_count and note; `old` are all links, `new` those of the parents, both with parent_id and
    child_path, of which the first row of a pair counts. An image that no document shows any more is pending; one that is shown
    now is done, has no chunks of its own, and a note.
    """
    again = parents.select(F.col("document_id").alias("parent_id")).distinct()
    links = old.join(again, "parent_id", "left_anti").unionByName(new.dropDuplicates(["parent_id", "child_path"]))
    lost = dropped_links(old, links).withColumn("_lost", F.lit(True))
    shown = new.select("child_path").distinct().withColumn("_shown", F.lit(True))
    met = docs.join(lost, F.col("path") == lost["child_path"], "left").drop("child_path").join(shown, F.col("path") == shown["child_path"], "left").drop("child_path")
    status = F.when(F.col("_shown"), "done").when(F.col("_lost"), "pending").otherwise(F.col("status"))
    told = {"status": status, "chunk_count": F.when(F.col("_shown"), 0).otherwise(F.col("chunk_count")), "note": F.when(F.col("_shown"), LINKED).otherwise(F.col("note"))}
    return links, met.withColumns(told).drop("_lost", "_shown")


def delete_documents(docs: DataFrame, links: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (document_id, path, kind, status, pair_id) and links after those of `lost` (document_id) are gone.

    Images they showed and PDFs that lose their transcription are pending again; nothing points at a lost document.
    """
    gone = lost.select("document_id").distinct()
    by_parent = links.join(gone.withColumnRenamed("document_id", "parent_id"), "parent_id", "left_semi")
    orphans = by_parent.select("child_path").distinct().withColumn("_o", F.lit(True))
    unpaired = gone.select(F.col("document_id").alias("_gone"))
    left = docs.join(gone, "document_id", "left_anti").join(orphans, F.col("path") == F.col("child_path"), "left").join(unpaired, F.col("pair_id") == F.col("_gone"), "left")
    redo = F.coalesce("_o", F.lit(False)) | (F.col("_gone").isNotNull() & (F.col("kind") == "pdf"))
    told = {"status": F.when(redo, "pending").otherwise(F.col("status")), "pair_id": F.when(F.col("_gone").isNull(), F.col("pair_id"))}
    kept = links.join(gone.withColumnRenamed("document_id", "parent_id"), "parent_id", "left_anti")
    return left.withColumns(told).drop("_o", "child_path", "_gone"), kept


def apply_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Documents (document_id, path, kind, status, pair_id) with the pairs (md_path, pdf_path) both ways.

    A PDF that gains or loses its transcription is pending, since its own text is read only without one.
    """
    ids = docs.select(F.col("path").alias("_path"), F.col("document_id").alias("_id"))
    named = pairs.join(ids.select(F.col("_path").alias("md_path"), F.col("_id").alias("_md")), "md_path").join(ids.select(F.col("_path").alias("pdf_path"), F.col("_id").alias("_pdf")), "pdf_path")
    both = named.select(F.col("_md").alias("document_id"), F.col("_pdf").alias("_pair")).union(named.select("_pdf", "_md"))
    met = docs.join(both, "document_id", "left")
    flips = (F.col("kind") == "pdf") & (F.col("pair_id").isNull() != F.col("_pair").isNull())
    return met.withColumns({"status": F.when(flips, "pending").otherwise(F.col("status")), "pair_id": F.col("_pair")}).drop("_pair")


def enqueue(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Jobs (document_id, state, attempts, enqueued_at) with those of `ids` (document_id) waiting anew, without attempts."""
    own = ids.select("document_id").distinct()
    fresh = own.select("document_id", F.lit("queued").alias("state"), F.lit(0).alias("attempts"), now.alias("enqueued_at"))
    return jobs.join(own, "document_id", "left_anti").select(*fresh.columns).unionByName(fresh)


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a run was cut off: running ones wait again."""
    return jobs.withColumn("state", F.when(F.col("state") == "running", "queued").otherwise(F.col("state")))


def cached(asked: DataFrame, cache: DataFrame, space: str, dim: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """What the cache knows of the queries, and the cache afterwards.

    `asked` has query_id and text; `cache` space, query, vector, hits and last_used. Queries match by their normal form. The
    first result has query_id, query and vector, null if there is none of this space and length; the second counts a hit
    for every asked row.
    """
    wanted = asked.select("query_id", T.normal_query(F.col("text")).alias("query"))
    known = cache.where(F.col("space") == space)
    met = wanted.join(known.select("query", "vector"), "query", "left").select("query_id", "query", F.when(F.size("vector") == dim, F.col("vector")).alias("vector"))
    uses = wanted.groupBy("query").agg(F.count("*").alias("_u"))
    used = known.join(uses, "query").withColumns({"hits": F.col("hits") + F.col("_u"), "last_used": now}).drop("_u")
    rest = cache.where(F.col("space") != space).unionByName(known.join(uses.select("query"), "query", "left_anti").select(*cache.columns))
    return met, rest.unionByName(used.select(*cache.columns))


def job_order(jobs: DataFrame) -> DataFrame:
    rank = F.lit(5)
    for kind, n in PRIORITY.items():
        rank = F.when(F.col("kind") == kind, n).otherwise(rank)
    return jobs.orderBy(rank, "enqueued_at", "path")


def step_jobs(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Jobs after a run: done ones are gone, failed ones count an attempt and wait again while attempts are left."""
    met = jobs.join(outcomes, "document_id", "left").where("coalesce(outcome, '') <> 'done'")
    attempts = F.col("attempts") + (F.coalesce("outcome", F.lit("")) == "failed").cast("int")
    return met.select("document_id", attempts.alias("attempts"), F.when(attempts >= MAX_ATTEMPTS, "failed").otherwise("queued").alias("state"))


def upsert_latest(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """One row per key: the latest by `order`, then `tie`; with hits, the number of rows."""
    latest = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    return rows.withColumns({"_n": F.row_number().over(latest), "hits": F.count("*").over(Window.partitionBy(key))}).where("_n = 1").drop("_n")


def evict(cache: DataFrame, oldest: Column | None, most: int) -> DataFrame:
    """The cache without rows used before `oldest` (None: rows don't age), then without the least used, oldest first, beyond `most` rows."""
    fresh = cache if oldest is None else cache.where(F.col("last_used") >= oldest)
    return fresh.orderBy(F.desc("hits"), F.desc("last_used"), F.desc("key")).limit(most)


def put_cached(cache: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """The cache (space, query, vector, hits, last_used) with the vectors of `fresh` (space, query, vector); known queries keep their hits."""
    own = fresh.dropDuplicates(["space", "query"]).select("space", "query", F.col("vector").alias("_v"))
    known = cache.join(own, ["space", "query"], "full")
    came = F.col("_v").isNotNull()
    told = {"vector": F.coalesce("_v", "vector"), "hits": F.coalesce("hits", F.lit(0)), "last_used": F.when(came, now).otherwise(F.col("last_used"))}
    return known.withColumns(told).select(*cache.columns)


def work_cost(kind: Column, size: Column) -> Column:
    unit = F.lit(None).cast("double")
    for name, n in UNIT_BYTES.items():
        unit = F.when(kind == name, float(n)).otherwise(unit)
    return F.when(kind == "image", 1.0).otherwise(F.greatest(F.lit(1.0), size / unit))


def moving_rates(samples: DataFrame, key: str, at: str, tie: str, value: str, known: DataFrame | None = None) -> DataFrame:
    """`key`, samples, rate: the exponentially weighted mean of all samples of a key in order of time; the first one starts it, or the
    rate in `known` (`key`, rate).

    The samples of an hour are folded to their number and their part in the mean, and the hours of a key then: a mean of n
    more samples is the one before times (1 - ALPHA) ** n, plus their part. So no task gets all samples of a key.
    """
    one = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(value).cast("double").alias("value"))
    hours = samples.groupBy(key, F.date_trunc("hour", at).alias("_hour")).agg(F.array_sort(F.collect_list(one)).alias("_own"))
    part = F.aggregate("_own", F.lit(0.0), lambda a, x: a * (1 - ALPHA) + x["value"] * ALPHA)
    step = F.struct("_hour", F.size("_own").cast("long").alias("n"), part.alias("part"), F.get("_own", F.lit(0))["value"].alias("first"))
    all_hours = hours.groupBy(key).agg(F.array_sort(F.collect_list(step)).alias("_h"))
    start = F.get("_h", F.lit(0))["first"]
    if known is not None:
        all_hours = all_hours.join(known.select(key, F.col("rate").alias("_known")), key, "left")
        start = F.coalesce("_known", start)
    rate = F.aggregate("_h", start, lambda a, x: a * F.pow(F.lit(1 - ALPHA), x["n"]) + x["part"])
    return all_hours.select(key, F.aggregate("_h", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("samples"), rate.alias("rate"))


def rate_of(kind: Column, measured: Column) -> Column:
    """Seconds a unit: as measured, else the usual ones of the kind."""
    usual = F.lit(1.0)
    for name, seconds in USUAL_RATES.items():
        usual = F.when(kind == name, seconds).otherwise(usual)
    return F.coalesce(measured, usual)


def progress(jobs: DataFrame, rates: DataFrame) -> DataFrame:
    """percent, eta: how much of the work of all jobs is done, by cost, and the seconds that the rest takes.

    `jobs` has kind, cost and done, the share that is done of each (0 to 1); `rates` kind and rate, seconds a unit, where measured.
    """
    share = F.least(F.greatest("done", F.lit(0.0)), F.lit(1.0))
    met = jobs.join(rates.select("kind", "rate"), "kind", "left")
    left = F.col("cost") * (1 - share) * rate_of(F.col("kind"), F.col("rate"))
    percent = F.least(F.lit(100.0), 100 * F.sum(F.col("cost") * share) / F.sum("cost"))
    return met.agg(F.coalesce(percent, F.lit(100.0)).alias("percent"), F.coalesce(F.sum(left), F.lit(0.0)).alias("eta"))


def list_documents(docs: DataFrame, status: str = "", kind: str = "") -> DataFrame:
    """Documents in order of path; an empty status or kind is any."""
    wanted = docs.where(F.col("status") == status) if status else docs
    return (wanted.where(F.col("kind") == kind) if kind else wanted).orderBy("path")


def with_pair_path(docs: DataFrame) -> DataFrame:
    """`docs` with pair_path, the path of the other document of a pair."""
    other = docs.select(F.col("document_id").alias("_other"), F.col("path").alias("pair_path"))
    return docs.join(other, F.col("pair_id") == F.col("_other"), "left").drop("_other")


def job_queue(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """Waiting jobs with path, kind and pair_path of their documents, the next one first."""
    named = with_pair_path(docs).select("document_id", "path", "kind", "pair_path")
    return job_order(jobs.where("state = 'queued'").join(named, "document_id"))


def pair_count(docs: DataFrame) -> DataFrame:
    """n: pairs, each of which its transcription counts."""
    return docs.where("kind = 'markdown' and pair_id is not null").agg(F.count("*").alias("n"))


def pair_warnings(texts: DataFrame, pdfs: DataFrame, found: DataFrame) -> DataFrame:
    """path, warning of texts that could not be paired as they ask: missing (front matter names no PDF that is there), taken (another
    text has it), several (PDFs of the text's name). See pairs() for the tables; `found` is its result."""
    md = texts.select(F.col("path"), "source", "mirror").join(found.select(F.col("md_path").alias("path")), "path", "left_anti")
    there = pdfs.select(F.col("path").alias("_pdf")).distinct()
    names = pdfs.select(stem(F.col("path")).alias("_stem"), "path").groupBy("_stem").agg(F.count("*").alias("_n"), F.min("path").alias("_single"))
    met = md.join(there, F.col("source") == F.col("_pdf"), "left").withColumn("_own", stem(F.col("path"))).join(names, F.col("_own") == F.col("_stem"), "left")
    told = (
        F.when(F.col("source").isNotNull() & F.col("_pdf").isNull(), "missing")
        .when(F.col("source").isNotNull(), "taken")
        .when(F.col("_n") > 1, "several")
        .when(F.col("_n") == 1, "taken")
    )
    return met.select("path", told.alias("warning")).where("warning is not null")


def insert_missing(rows: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with those of `fresh` whose keys it lacks; of several with one key one comes in."""
    return rows.unionByName(fresh.dropDuplicates(keys).join(rows.select(*keys), keys, "left_anti").select(*rows.columns))


def enqueue_while(jobs: DataFrame, dirty: DataFrame, ids: DataFrame, switching: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs and dirty documents (document_id) after those of `ids` are queued: they are dirty too while `switching` has a row."""
    under_way = switching.limit(1).select(F.lit(1).alias("_on"))
    marked = ids.select("document_id").crossJoin(under_way).select("document_id")  # one row at most
    return enqueue(jobs, ids, now), insert_missing(dirty.select("document_id"), marked, ["document_id"])


def claim(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs with the waiting ones of `ids` running."""
    own = ids.select("document_id").distinct().withColumn("_c", F.lit(True))
    met = jobs.join(own, "document_id", "left")
    return met.withColumn("state", F.when(F.col("_c") & (F.col("state") == "queued"), "running").otherwise(F.col("state"))).drop("_c")


def requeued(jobs: DataFrame) -> DataFrame:
    """Jobs with failed ones waiting again while attempts are left."""
    again = (F.col("state") == "failed") & (F.col("attempts") < MAX_ATTEMPTS)
    return jobs.withColumn("state", F.when(again, "queued").otherwise(F.col("state")))


def skip_media(jobs: DataFrame, can: list[str]) -> DataFrame:
    """`jobs` (document_id, kind) with status and note: those of sound or video that the model can't read are done, without chunks."""
    skipped = F.col("kind").isin("audio", "video") & ~F.col("kind").isin(can)
    return jobs.withColumns({"status": F.when(skipped, "done").otherwise("pending"), "note": F.when(skipped, F.concat(F.lit("no vectors of "), "kind"))})


def skip_linked(jobs: DataFrame, links: DataFrame) -> DataFrame:
    """document_id and note of the jobs (document_id, kind, path) of images that a document shows: done, without chunks of their own."""
    shown = links.select(F.col("child_path").alias("path")).distinct()
    return jobs.where("kind = 'image'").join(shown, "path", "left_semi").select("document_id", F.lit(LINKED).alias("note"))


def mark_stale(docs: DataFrame, removed: list[str]) -> DataFrame:
    """Documents with those below the removed folders, a handful, stale."""
    below = F.lit(False)
    for folder in removed:
        below = below | folder_covers(F.lit(folder), F.col("path"))
    return docs.withColumn("status", F.when(below, "stale").otherwise(F.col("status")))


def consent_totals(jobs: DataFrame, by: str) -> DataFrame:
    """`by`, n, images, pdf_bytes of the jobs (kind, bytes): what a service would be sent."""
    sent = F.sum(F.when(F.col("kind") == "pdf", F.col("bytes")).otherwise(0.0))
    return jobs.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "image").alias("images"), F.round(sent, 3).alias("pdf_bytes"))


def frequencies_after(frequencies: DataFrame, post: DataFrame, lost: DataFrame) -> DataFrame:
    """term, df_before, df_after: document frequencies once the chunks of `lost` (chunk_id) are gone; a term of none is left with 0."""
    gone = post.join(lost.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("term").agg(F.count("*").alias("_gone"))
    met = frequencies.select("term", F.col("df").alias("df_before")).join(gone, "term", "left")
    return met.select("term", "df_before", (F.col("df_before") - F.coalesce("_gone", F.lit(0))).alias("df_after"))
