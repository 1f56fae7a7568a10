"""Memory of conversations: short term, promotion, recall, context. "Now" is always given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import scoring, text

CAPACITY, CONTEXT = 50, 5
PASS = 0.7


def newest(items: DataFrame, n: int = CAPACITY, by: str = "session_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest ``n`` items of each session."""
    order = Window.partitionBy(by).orderBy(F.desc(at), F.desc(tie))
    return items.withColumn("age", F.row_number().over(order)).where(F.col("age") <= n)


def access_counts(items: DataFrame, by: str = "session_id", at: str = "ts", tie: str = "event_id", most: int = 10) -> DataFrame:
    """How often an item has been looked at: each later item of its session looks once, up to ``most``."""
    order = Window.partitionBy(by).orderBy(F.desc(at), F.desc(tie))
    return items.withColumn("access_count", F.least(F.lit(most), F.row_number().over(order)))


def promoted(items: DataFrame, as_of: Column, threshold: float = PASS) -> DataFrame:
    """total and promoted for items with ts, score and access_count."""
    hours = (F.unix_micros(as_of) - F.unix_micros("ts")) / 3_600_000_000
    total = scoring.promotion(hours, F.col("score"), F.col("access_count"))
    return items.withColumn("total", F.round(total, 6)).withColumn("promoted", total >= threshold - 1e-9)


def recent(items: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return items.where((F.col("ts") <= as_of) & (F.col("ts") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")))


def qa_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: a user's turn with the assistant's next one."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    ahead = turns.withColumn("next_role", F.lead("role").over(order)).withColumn("answer", F.lead("text").over(order))
    return ahead.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def context_window(pairs: DataFrame, n: int = CONTEXT) -> DataFrame:
    """The last ``n`` pairs of each conversation, joined in order."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = pairs.withColumn("age", F.row_number().over(order)).where(F.col("age") <= n)
    joined = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("pair")))).alias("pairs"))
    return joined.select("conv_id", F.size("pairs").alias("n_pairs"), F.array_join(F.transform("pairs", lambda p: p["pair"]), "\n\n").alias("context"))


def compressed(body: Column, most_sentences: int = 5, most_chars: int = 2048) -> Column:
    """Without a model: the first sentences."""
    return F.substring(F.array_join(F.slice(text.plain_sentences(body), 1, most_sentences), ". "), 1, most_chars)


def compressed_many(bodies: DataFrame, by: str, most_chars: int = 2048) -> DataFrame:
    """``by`` and text: without a model, the bodies (by, position, text, score) of each group, the highest score first, up to ``most_chars``. Bodies without
    text go, a missing score is 0.5, and equal scores keep their order."""
    kept = bodies.withColumn("text", text.strip(F.coalesce("text", F.lit("")))).where("text <> ''").withColumn("score", F.coalesce("score", F.lit(0.5)))
    order = Window.partitionBy(by).orderBy(F.desc("score"), "position").rowsBetween(Window.unboundedPreceding, -1)
    # what stands behind the bound need not be gathered
    needed = kept.withColumn("before", F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0))).where(F.col("before") < most_chars)
    joined = needed.groupBy(by).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "position", "text"))).alias("parts"))
    return joined.select(by, text.strip(F.substring(F.array_join(F.col("parts.text"), " "), 1, most_chars)).alias("text"))


def lookup(items: DataFrame, query: Column, k: int = 8) -> DataFrame:
    """The k items (item_id, embedding, score) closest to a vector, those without a vector by their stored score."""
    near = F.when(F.size("embedding") > 0, F.greatest(F.lit(0.0), scoring.cosine(F.col("embedding"), query))).otherwise(F.col("score"))
    return items.withColumn("similarity", F.round(near, 6)).orderBy(F.desc("similarity"), "item_id").limit(k)


def similarity(bodies: DataFrame, query: Column) -> DataFrame:
    """item_id, score: the mean clamped cosine of an item's bodies (item_id, embedding) to a vector, 0.5 where it is 0."""
    one = F.least(F.lit(1.0), F.greatest(F.lit(0.0), scoring.cosine(F.col("embedding"), query)))
    mean = bodies.where(F.size("embedding") > 0).groupBy("item_id").agg(F.avg(one).alias("mean"))
    return mean.select("item_id", F.round(F.when(F.col("mean") == 0, 0.5).otherwise(F.col("mean")), 6).alias("score"))


def without(items: DataFrame, gone: DataFrame, key: str = "event_id") -> DataFrame:
    """A buffer without the items in ``gone``."""
    return items.join(gone.select(key).distinct(), key, "left_anti")


def promotion_stores(items: DataFrame, as_of: Column, threshold: float = PASS) -> DataFrame:
    """``items`` as they stand after a promotion: promoted ones in the long-term and the episodic store, all others in the
    buffer (``store``)."""
    judged = promoted(items, as_of, threshold)
    stores = F.when(F.col("promoted"), F.array(F.lit("long_term"), F.lit("episodic"))).otherwise(F.array(F.lit("short_term")))
    return judged.withColumn("store", F.explode(stores))


def recall(short: DataFrame, long: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """query_id, rank, store, item_id, similarity: the best k of both stores for each of ``queries`` (query_id, embedding).

    An item of ``short`` (item_id, embedding, score) may have several rows, one a body: its best cosine counts, or its stored
    score where no body has a vector. ``long`` has item_id and embedding. Both stores are searched as ``search.best_pairs`` does, so queries
    may be many; vectors of another length than a query's are no match.
    """
    from corvane.operators import search

    asks = queries.select("query_id", "embedding")
    vectors = lambda store: store.where(F.size("embedding") > 0).select(F.col("item_id").alias("chunk_id"), "embedding")
    cosine = F.greatest(F.lit(0.0), 2 * F.col("score") - 1).alias("similarity")  # of a score, which is (1 + cosine) / 2
    own = search.best_pairs(vectors(short), asks, k, distinct=True).groupBy("query_id", F.col("chunk_id").alias("item_id")).agg(F.max("score").alias("score")).select("query_id", "item_id", cosine)
    # items without any vector: the best k of them are the same for all queries
    bare = short.groupBy("item_id").agg(F.max(F.when(F.size("embedding") > 0, True)).alias("has"), F.max("score").alias("similarity")).where("has is null")
    bare = bare.orderBy(F.desc(F.round("similarity", 9)), "item_id").limit(k).select("item_id", "similarity")
    own = own.unionByName(asks.select("query_id").join(F.broadcast(bare)).select("query_id", "item_id", "similarity"))  # k rows are sent
    others = search.best_pairs(vectors(long), asks, k).select("query_id", F.col("chunk_id").alias("item_id"), cosine)
    both = own.withColumn("store", F.lit("short")).unionByName(others.withColumn("store", F.lit("long")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "store", "item_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "store", "item_id", F.round("similarity", 6).alias("similarity"))


def episodic(events: DataFrame, vectors: DataFrame, queries: DataFrame, as_of: Column, days: int = 7, k: int = 2) -> DataFrame:
    """session_id, rank, event_id, similarity, text: the k events of a session in the last days that are nearest to its query.

    ``vectors`` (event_id, embedding) and ``events`` (session_id, event_id, ts, text) are two stores; an event has to be in
    both. ``queries`` has session_id and embedding.
    """
    near = recent(events, as_of, days).select("session_id", "event_id").join(vectors, "event_id")
    asked = near.join(queries.select("session_id", F.col("embedding").alias("ask")), "session_id")
    asked = asked.withColumn("similarity", scoring.cosine(F.col("embedding"), F.col("ask")))
    order = Window.partitionBy("session_id").orderBy(F.desc(F.round("similarity", 9)), "event_id")
    best = asked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("session_id", "rank", "event_id", F.round("similarity", 6).alias("similarity")).join(events.select("event_id", "text"), "event_id")


def assembled(parts: list[tuple[str, Column]]) -> Column:
    """Sections of a context under their headings; those without a body are left out."""
    return F.concat_ws("\n\n", *[F.when(F.length(body) > 0, F.concat(F.lit(f"## {name}\n"), body)) for name, body in parts])


def context_items(items: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """query_id, rank, item_id: for each query (query_id, embedding) the k nearest items (item_id, at, embedding); a query
    without a vector has the newest ones, and with k below 1 there are none."""
    from corvane.operators import search

    if k < 1:
        return queries.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")).limit(0)
    near = search.dense(items.select(F.col("item_id").alias("chunk_id"), "embedding"), queries.where("embedding is not null"), k).select("query_id", "rank", F.col("chunk_id").alias("item_id"))
    newest_items = items.orderBy(F.desc("at"), F.desc("item_id")).limit(k).select("item_id", "at")
    order = Window.orderBy(F.desc("at"), F.desc("item_id"))  # k rows
    last = newest_items.select(F.row_number().over(order).alias("rank"), "item_id")
    return near.unionByName(queries.where("embedding is null").select("query_id").join(F.broadcast(last)))


def overview(stores: DataFrame, newest_short: int = 10, newest_long: int = 5) -> DataFrame:
    """store, n_items, position, event_id: what an inspector shows of ``stores`` (store, event_id, ts): the newest items of the
    buffer and of the long-term and episodic stores, and how many each store has."""
    order = Window.partitionBy("store").orderBy(F.desc("ts"), F.desc("event_id"))
    most = F.when(F.col("store") == "short_term", newest_short).otherwise(newest_long)
    shown = stores.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    counts = stores.groupBy("store").agg(F.count(F.lit(1)).alias("n_items"))
    return shown.join(F.broadcast(counts), "store").select("store", "n_items", "position", "event_id")
