"""Embeddings, vector search, summaries, session memory, prompt safety and retrieval answers."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline.functions.running import checkpointing
from siftline.functions.safety import MAX_LENGTH, OVERFLOW, THREATS

#: Rows and queries that one task of a block search holds, about, and queries that it scores at once.
ROW_BLOCK, QUERY_BLOCK, PAGE = 32_768, 16_384, 128
#: Rows for which a further task is worth its start.
FEW_ROWS = 1_024
#: Bytes of texts whose tokens a task hashes at once.
TEXT_BYTES = 1_000_000
#: Queries that may be sent to every task.
MAX_ASKED = 1_000
#: Which bytes tokens consist of.
_IN_TOKEN = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def _counted(data: np.ndarray, ends: np.ndarray, dims: int, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts: a line of `dims` for each text, powers of 31 modulo `dims`) of texts in one run of bytes; text k stands
    between ends k and k + 1. All tokens are hashed at once: characters times powers, summed by token."""
    n, at = len(ends) - 1, np.flatnonzero(_IN_TOKEN[data])
    if not len(at):
        return np.zeros((n, dims), np.int64), power
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) != 1
    first = np.searchsorted(at, ends[:-1])
    new[first[first < len(at)]] = True
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    while len(power) < length.max():
        power = np.concatenate([power, power * pow(31, len(power), dims) % dims])
    after = np.repeat(begin + length, length) - 1 - np.arange(len(at))
    bucket = np.add.reduceat(data[at] * power[after] % dims, begin) % dims
    text = np.searchsorted(ends, at[begin], "right") - 1
    return np.bincount(text * dims + bucket, minlength=n * dims).reshape(n, dims), power


def _token_counts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(keys, counts: a line of `dims` for each) of (key, text) in lower case."""
    power = np.ones(1, np.int64) % dims
    for b in batches:
        texts = pc.fill_null(b.column(1), "").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        data, lo = np.frombuffer(texts.buffers()[2] or b"", np.uint8), 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + TEXT_BYTES, "right")) - 1)
            counts, power = _counted(data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo], dims, power)
            yield b.column(0).slice(lo, hi - lo), counts
            lo = hi


def hash_embedding(rows: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """(key, dim, n): token counts in `dims` buckets; a token's bucket is its polynomial hash (base 31) modulo `dims`.

    Tokens are hashed and counted where they are read, so at most `dims` rows of a text are shuffled. An interpreted
    expression over each character takes about twenty times as long as this map.
    """
    kind = rows.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _token_counts(batches, dims):
            row, dim = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(dim, pa.int32()), pa.array(counts[row, dim])], [key, "dim", "n"])

    counted = rows.select(key, F.lower(text).alias("_text")).mapInArrow(count, f"{key} {kind}, dim int, n long")
    return counted.groupBy(key, "dim").agg(F.sum("n").alias("n"))


def hash_vectors(rows: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """(key, vector): the counts of `hash_embedding` as vectors; texts without tokens have none.

    A text is one row from the map on; rows that share a key are added up.
    """
    kind = rows.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _token_counts(batches, dims):
            some = counts.any(axis=1)
            ends = pa.array(np.arange(some.sum() + 1) * dims, pa.int32())
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(counts[some].ravel().astype(float)))], [key, "vector"])

    counted = rows.select(key, F.lower(text).alias("_text")).mapInArrow(count, f"{key} {kind}, vector array<double>")
    of_key = counted.groupBy(key).agg(F.collect_list("vector").alias("_v"))
    added = F.aggregate(F.slice("_v", 2, F.size("_v")), F.col("_v")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return of_key.select(key, added.alias("vector"))


def dot(a: Column, b: Column) -> Column:
    """Over the first dimensions that both have."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def similarity_search(rows: DataFrame, queries: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k rows most like each query vector; ties go to the smaller id.

    For up to `MAX_ASKED` request rows, which travel to the scan; each task keeps its own k best of each query before
    anything is shuffled. More of them are searched by `block_search`.
    """
    if queries.limit(MAX_ASKED + 1).count() > MAX_ASKED:
        return block_search(rows, queries, k, min_score)
    asked = queries.select("query_id", F.col("vector").alias("_q"))
    scored = rows.crossJoin(F.broadcast(asked)).select("query_id", "id", cosine(F.col("vector"), F.col("_q")).alias("score"))
    if min_score is not None:
        scored = scored.filter(F.col("score") >= min_score)
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _padded(col: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, which change no inner product."""
    col = col.combine_chunks()
    size = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(size), max(1, int(size.max(initial=0)))))
    out[np.arange(out.shape[1]) < size[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def _first_copies(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that have k copies with smaller ids, as these come first with every query."""
    _, copy = np.unique(v, axis=0, return_inverse=True)
    order = np.lexsort((ids, copy.ravel()))
    copy = copy.ravel()[order]
    return order[np.arange(len(ids)) - np.searchsorted(copy, copy) < k]


def _floors(rough: np.ndarray, k: int) -> np.ndarray:
    """For each line of scores what its k-th best is at least: the k-th best of the best of each of some columns."""
    n = rough.shape[1]
    if n <= k:
        return np.full(len(rough), -np.inf, np.float32)
    m = min(n, max(k, 512))
    best = rough[:, : n // m * m].reshape(len(rough), n // m, m).max(axis=1)
    return np.partition(best, m - k, axis=1)[:, m - k]


def ranked_block(block: pa.Table, asks: np.ndarray, k: int, min_score: float | None, keep: str | None = None) -> pa.Table:
    """(query_id, id, score, _near): the k best rows of a block for each of its queries, which `asks` marks; `keep` is a
    column of the queries that their lines carry along.

    All pairs are scored in single precision; those within its error of the k best are scored again in double precision,
    which alone decides.
    """
    out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]]
    if asks.any() and not asks.all():
        ids, v = block.column("id").to_numpy(), _padded(block.column("v"))
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        q_ids, q, ids, c = ids[asks], v[asks], ids[~asks], v[~asks]
        first = _first_copies(ids, c, k)
        ids, c = ids[first], c[first]
        rough_q, rough_c = q.astype(np.float32), c.T.astype(np.float32)
        # What rounding may add to two scores, and to scores that nine digits make equal.
        slack = np.float32((v.shape[1] + 4) * 2.0**-23 + 2e-9)
        smallest = np.argsort(ids)[:k]
        for lo in range(0, len(q), PAGE):
            rough = rough_q[lo : lo + PAGE] @ rough_c
            floor = _floors(rough, k) - slack
            if min_score is not None:
                floor = np.maximum(floor, np.float32(min_score) - slack)
            for n, (line, least) in enumerate(zip(rough, floor), lo):
                # A zero vector is as near to all.
                at = np.flatnonzero(line >= least) if rough_q[n].any() else smallest
                score = c[at] @ q[n]
                if min_score is not None:
                    at, score = at[score >= min_score], score[score >= min_score]
                near = np.round(score, 9)
                order = np.lexsort((ids[at], -near))[:k]
                at, score = at[order], score[order]
                out[0].append(np.full(len(at), q_ids[n])), out[1].append(ids[at]), out[2].append(score), out[3].append(np.full(len(at), n))
    query_id, found, score, n = map(np.concatenate, out)
    made = {"query_id": query_id, "id": found, "score": score, "_near": np.round(score, 9)}
    if keep:
        made[keep] = block.column(keep).filter(pa.array(asks)).take(pa.array(n))
    return pa.table(made)


def block_search(rows: DataFrame, queries: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """(query_id, rank, id, score) as `similarity_search`, for queries that grow with the rows.

    Blocks of queries meet blocks of rows in one task each, which keeps its own k best of each query; those are merged.
    Vectors are made once, hits too. Vectors that are null or hold null or non-finite components take no part.
    """
    checkpointing(rows.sparkSession)
    cores = rows.sparkSession.sparkContext.defaultParallelism

    def usable(df: DataFrame, key: str) -> DataFrame:
        v = F.transform("vector", lambda x: x.cast("double"))
        df = df.select(F.col(key).cast("long").alias("id"), v.alias("v"))
        return df.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))

    held, asked = usable(rows, "id").checkpoint(), usable(queries, "query_id").checkpoint()
    n_held = held.count()
    n_rows = max(1, -(-n_held // ROW_BLOCK), min(cores, n_held // FEW_ROWS))
    n_asked = max(1, -(-asked.count() // QUERY_BLOCK))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int, asks: bool) -> DataFrame:
        at = F.pmod(F.xxhash64("id", "v"), F.lit(n_own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        return df.select("id", "v", F.lit(asks).alias("asks"), at.alias(own), every.alias(other))

    def best(block: pa.Table) -> pa.Table:
        return ranked_block(block, block.column("asks").to_numpy(), k, min_score)

    both = dealt(held, "_r", n_rows, "_q", n_asked, False).unionByName(dealt(asked, "_q", n_asked, "_r", n_rows, True))
    found = both.groupBy("_r", "_q").applyInArrow(best, "query_id long, id long, score double, _near double")
    order = W.partitionBy("query_id").orderBy(F.desc("_near"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score").checkpoint()


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def summarise(text: Column) -> dict[str, Column]:
    """A headline (the first sentence, 120 characters at most), a paragraph (three sentences) and a detailed excerpt."""
    s = sentences(text)
    return {
        "headline": F.substring(F.get(s, F.lit(0)), 1, 120),
        "paragraph": F.array_join(F.slice(s, 1, 3), " "),
        "detailed": F.when(F.length(text) > 800, F.concat(F.substring(text, 1, 800), F.lit("…"))).otherwise(text),
    }


def threats(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., n_threats, threat_types, max_severity, risk_level, safe): one projection, no shuffle."""
    counts = [F.regexp_count(F.col(text), F.lit(p)) for *_, p in THREATS]
    over = (F.length(text) > MAX_LENGTH).cast("int")
    hits = F.array(
        F.struct(F.lit(OVERFLOW[0]).alias("t"), F.lit(OVERFLOW[1]).alias("s"), over.alias("n")),
        *[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s"), n.alias("n")) for (t, s, _), n in zip(THREATS, counts)],
    )
    found = rows.select(*keep, hits.alias("_all")).select(*keep, F.filter("_all", lambda h: h["n"] > 0).alias("_hit"))
    worst = F.coalesce(F.array_max(F.transform("_hit", lambda h: h["s"])), F.lit(0.0))
    return found.select(
        *keep,
        F.aggregate("_hit", F.lit(0), lambda n, h: n + h["n"]).cast("long").alias("n_threats"),
        F.array_join(F.array_distinct(F.transform("_hit", lambda h: h["t"])), ", ").alias("threat_types"),
        worst.alias("max_severity"),
    ).withColumns(
        {
            "risk_level": F.when(F.col("max_severity") >= 0.8, "critical").when(F.col("max_severity") >= 0.6, "high")
            .when(F.col("max_severity") >= 0.4, "medium").otherwise("low"),
            "safe": F.col("max_severity") < 0.7,
        }
    )


def sanitise(text: Column) -> Column:
    """The text with what `threats` finds made harmless: severities of 0.7 and above become [REMOVED], those of 0.5 and
    above stand in backticks. Patterns go in order; each match in the text as it came replaces its first occurrence in
    the text as it is by then."""

    def replaced(severity: float):
        def step(acc: Column, m: Column) -> Column:
            at = F.instr(acc, m)
            by = F.lit("[REMOVED]") if severity >= 0.7 else F.concat(F.lit("`"), m, F.lit("`"))
            cut = F.concat(F.substring(acc, F.lit(1), at - 1), by, F.substring(acc, at + F.length(m), F.length(acc)))
            return F.when(at > 0, cut).otherwise(acc)

        return step

    out = text
    for _, severity, pattern in THREATS:
        if severity >= 0.5:
            out = F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), out, replaced(severity))
    return out


def safety_summary(found: DataFrame) -> dict[str, Column]:
    """The confidence that a text is safe, and a line that says so or what was found (rows of `threats`)."""
    sure = 1 - F.col("max_severity")
    safe = F.concat(F.lit("Content appears safe ("), F.floor(sure * 100 + 0.5).cast("string"), F.lit("% confidence)"))
    bad = F.concat(F.col("n_threats").cast("string"), F.lit(" threat(s) detected: "), F.col("threat_types"), F.lit(" (Risk: "), F.col("risk_level"), F.lit(")"))
    return {"confidence": sure, "summary": F.when(F.col("safe"), safe).otherwise(bad)}


def session_memory(turns: DataFrame) -> DataFrame:
    """(conv_id, n_entries, transcript): the entries of each session in order."""
    entries = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = turns.groupBy("conv_id").agg(entries.alias("e"))
    lines = F.transform("e", lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return rows.select("conv_id", F.size("e").cast("long").alias("n_entries"), F.array_join(lines, "\n").alias("transcript"))


def screened_answers(hits: DataFrame, texts: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, n_sources, n_unsafe, safe, context, citations, headline, paragraph, n_sentences): what a question's hits say,
    made harmless, and summaries of it.

    hits (query_id, rank, id), texts (id, text), questions (query_id, text). Each text that is hit is screened once. A
    question is safe if neither it nor any of its sources holds a threat that counts; questions without hits have none.
    """
    docs = texts.join(hits.select("id").distinct(), "id")
    docs = threats(docs.withColumn("clean", sanitise(F.col("text"))), "text", "id", "clean").select("id", "clean", "safe")
    asked = threats(questions, "text", "query_id").select("query_id", F.col("safe").alias("asked_safe"))
    sources = F.array_sort(F.collect_list(F.struct("rank", "id", "clean")))
    got = hits.join(docs, "id").groupBy("query_id").agg(sources.alias("s"), F.count_if(~F.col("safe")).alias("n_unsafe"))
    line = F.transform("s", lambda x: F.concat(F.lit("Source "), x["rank"].cast("string"), F.lit(": "), F.coalesce(x["clean"], F.lit(""))))
    cite = F.transform("s", lambda x: F.concat(x["id"].cast("string"), F.lit("|"), F.substring(F.coalesce(x["clean"], F.lit("")), 1, 200)))
    rows = asked.join(got, "query_id", "left").select(
        "query_id", F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n_sources"), F.coalesce("n_unsafe", F.lit(0)).cast("long").alias("n_unsafe"), "asked_safe",
        F.coalesce(F.array_join(line, "\n"), F.lit("")).alias("context"), F.coalesce(F.array_join(cite, "\n"), F.lit("")).alias("citations"),
    )
    said = summarise(F.col("context"))
    rows = rows.withColumns({"headline": said["headline"], "paragraph": said["paragraph"], "safe": F.col("asked_safe") & (F.col("n_unsafe") == 0)}).drop("asked_safe")
    some = F.filter(sentences(F.col("paragraph")), lambda x: F.trim(x) != "")
    return rows.withColumn("n_sentences", F.size(some).cast("long"))


def answers(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, n_sources, context, citations): retrieved texts, numbered by rank, and their excerpts."""
    rows = hits.join(texts, "id")
    sources = F.array_sort(F.collect_list(F.struct("rank", "id", "text")))
    got = rows.groupBy("query_id").agg(sources.alias("s"))
    line = F.transform("s", lambda x: F.concat(F.lit("Source "), x["rank"].cast("string"), F.lit(": "), x["text"]))
    cite = F.transform("s", lambda x: F.concat(x["id"].cast("string"), F.lit("|"), F.substring(x["text"], 1, 200)))
    return got.select("query_id", F.size("s").cast("long").alias("n_sources"), F.array_join(line, "\n\n").alias("context"), F.array_join(cite, "\n").alias("citations"))
