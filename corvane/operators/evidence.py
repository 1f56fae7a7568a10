"""Checks of answers against their evidence, citations, and novelty of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.session import staged

OVERLAP = 0.10
LEAST_TOKENS = 4


def support(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, position, n_tokens, overlap, unsupported: each sentence of ``answers`` (answer_id, text) that has
    enough words against the words of its evidence (answer_id, text).

    Words are joined, not gathered: an answer's evidence may be any number of chunks.
    """
    sentence = answers.select("answer_id", F.posexplode(text.sentences(F.col("text"))).alias("position", "sentence"))
    words = sentence.select("answer_id", "position", text.evidence_tokens(F.col("sentence")).alias("tokens")).where(F.size("tokens") >= LEAST_TOKENS)
    words = words.select("answer_id", "position", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))
    known = evidence.select("answer_id", F.explode(text.evidence_tokens(F.col("text"))).alias("token")).distinct().withColumn("hit", F.lit(1))
    met = words.join(known, ["answer_id", "token"], "left").groupBy("answer_id", "position").agg(F.first("n_tokens").alias("n_tokens"), F.count("hit").alias("n_hit"))
    overlap = F.col("n_hit") / F.col("n_tokens")
    return met.select("answer_id", "position", "n_tokens", F.round(overlap, 6).alias("overlap"), (overlap < OVERLAP).alias("unsupported"))


def verdicts(facts: DataFrame, least: int = 1, need_citations: bool = False) -> DataFrame:
    """score and passed of answers with n_found, n_missing, n_sentences, n_unsupported, n_references, cited."""
    least = min(max(least, 1), 10)
    presence = F.least(F.col("n_found") / least, F.lit(1.0))
    backed = F.when(F.col("n_unsupported") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("n_unsupported") / F.greatest(F.col("n_sentences"), F.lit(1))))
    cited = F.when(F.col("cited") | F.lit(not need_citations), 1.0).otherwise(0.0)
    missing = F.least(F.col("n_missing") * 0.15, F.lit(0.45))
    listed = F.when(F.col("n_references") > 0, 0.1).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.45 * presence + 0.40 * backed + 0.15 * cited - missing - listed))
    enough = (F.col("n_found") >= least) | ((F.col("n_found") > 0) & (F.col("n_missing") > 0) & (F.col("n_found") / F.greatest(F.col("n_found") + F.col("n_missing"), F.lit(1)) >= 0.5))
    allowed = F.greatest(F.lit(1), F.floor(F.col("n_sentences") * 0.3))
    passed = enough & (F.col("n_unsupported") <= allowed) & (F.col("cited") | F.lit(not need_citations))
    return facts.withColumn("score", F.round(score, 6)).withColumn("passed", passed)


def citations(results: DataFrame, chunks: DataFrame, most: int = 200) -> DataFrame:
    """Numbered citations of ranked results: chunk, source, score and snippet."""
    met = results.join(chunks.select("chunk_id", "source_path", "text"), "chunk_id")
    return met.select("query_id", F.col("rank").alias("index"), "chunk_id", F.col("source_path").alias("source"), "score", text.snippet(F.col("text"), most).alias("text_snippet"))


def novelty(steps: DataFrame) -> DataFrame:
    """session, step, n_ids, n_new: how many ids of each step (session, step, chunk_id) no earlier step had."""
    first = steps.groupBy("session", "chunk_id").agg(F.min("step").alias("first"))
    met = steps.select("session", "step", "chunk_id").distinct().join(first, ["session", "chunk_id"])
    return met.groupBy("session", "step").agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("step") == F.col("first")).alias("n_new"))


def error_streaks(lines: DataFrame, n: int = 3) -> DataFrame:
    """session, longest, streak: the longest run of lines with ``[error]``, blank lines left out."""
    kept = lines.where(text.strip(F.col("line")) != "").withColumn("bad", F.lower("line").contains("[error]"))
    order = Window.partitionBy("session").orderBy("position")
    island = F.row_number().over(order) - F.row_number().over(Window.partitionBy("session", "bad").orderBy("position"))
    runs = kept.withColumn("island", island).groupBy("session", "bad", "island").agg(F.count(F.lit(1)).alias("n"))
    longest = F.coalesce(F.max(F.when(F.col("bad"), F.col("n"))), F.lit(0))
    return runs.groupBy("session").agg(longest.alias("longest"), (longest >= n).alias("streak"))


def consistent(evaluations: DataFrame) -> DataFrame:
    """Evaluations made consistent: replanning means neither passed nor more tools; a hard failure scores 0.2 at most."""
    status = F.when(F.col("status").isin("ok", "needs_replan", "hard_fail"), F.col("status")).otherwise("ok")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return evaluations.select(
        *[c for c in evaluations.columns if c not in ("status", "score", "passed", "require_more_tools", "issues")],
        status.alias("status"),
        F.round(F.when(status == "hard_fail", F.least(score, F.lit(0.2))).otherwise(score), 6).alias("score"),
        (F.col("passed") & (status == "ok")).alias("passed"),
        (F.col("require_more_tools") & (status == "ok")).alias("require_more_tools"),
        F.substring("issues", 1, 200).alias("issues"),
    )


GRAM = 6


def _grams(name: str, n) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substr(F.col(name), i, n)))


def containing(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """asked_id, chunk_id: all ids of ``chunks`` that contain an asked one.

    Ids meet in GRAM characters of the asked one (all, if it is shorter): those that the fewest chunks' ids have, so that ids which
    begin alike don't meet all. One of whose grams no id has is contained in none.
    """
    keyed = asked.select("asked_id").distinct().where(F.length("asked_id") > 0)
    keyed = keyed.withColumn("n", F.least(F.lit(GRAM), F.length("asked_id")))
    sizes = [r[0] for r in keyed.select("n").distinct().collect()] or [GRAM]  # GRAM numbers at most
    keyed = keyed.select("asked_id", "n", F.explode(_grams("asked_id", F.col("n"))).alias("gram"))
    ids = chunks.select("chunk_id").distinct().select("chunk_id", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n")).where(F.length("chunk_id") >= F.col("n"))
    have = ids.select("chunk_id", "n", F.explode(_grams("chunk_id", F.col("n"))).alias("gram"))
    counts = have.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("times"))
    rarest = keyed.join(counts, ["n", "gram"], "left").groupBy("asked_id", "n").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram")).alias("g"))
    rarest = rarest.where("g.times > 0").select("asked_id", "n", F.col("g.gram").alias("gram"))
    return have.join(rarest, ["n", "gram"]).where(F.contains("chunk_id", "asked_id")).select("asked_id", "chunk_id")


def resolve_ids(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """asked_id, chunk_id, exact for each id in ``asked`` (asked_id): the chunk with that id, else the first whose id
    contains it, else null."""
    met = containing(asked, chunks)
    best = met.groupBy("asked_id").agg(F.min(F.struct((F.col("chunk_id") != F.col("asked_id")).alias("partial"), "chunk_id")).alias("best"))
    return asked.select("asked_id").distinct().join(best, "asked_id", "left").select("asked_id", "best.chunk_id", (~F.col("best.partial")).alias("exact"))


def stalls(steps: DataFrame, least: int = 1) -> DataFrame:
    """``novelty`` with the number of steps up to each that bring nothing new, and whether ``least`` such stall the session."""
    found = novelty(steps).where("step is not null")
    session = Window.partitionBy("session").orderBy("step")
    group = F.sum((F.col("n_new") > 0).cast("int")).over(session)
    dry = F.count_if(F.col("n_new") == 0).over(Window.partitionBy("session", "group").orderBy("step"))
    return found.withColumn("group", group).withColumn("dry", dry).select("session", "step", "n_ids", "n_new", "dry", (F.col("dry") >= least).alias("stalled"))


def quick_rule(summaries: DataFrame, n: int = 3) -> DataFrame:
    """session, status, score, passed, issues: sessions whose logs (session, position, line) have ``n`` errors in a row fail at
    once; all others are still to be judged."""
    streaks = error_streaks(summaries, n)
    hard = F.col("streak")
    return streaks.select("session", F.when(hard, "hard_fail").otherwise("ok").alias("status"), F.when(hard, 0.0).alias("score"), F.when(hard, False).alias("passed"), F.when(hard, F.concat(F.lit(f"{n} calls in a row failed, of "), F.col("longest").cast("string"))).alias("issues"))


def observation(evaluations: DataFrame, most: int = 200) -> DataFrame:
    """An evaluation (status, passed, score, require_more_tools, issues array) as one short line."""
    from corvane.functions import text

    issues = F.array_join(F.filter("issues", lambda i: i != ""), "; ")
    parts = F.concat_ws("; ", F.concat(F.lit("status="), "status"), F.when(~F.col("passed"), "passed=False"), F.concat(F.lit("score="), F.format_number("score", 2)), F.when(F.col("require_more_tools"), "require_more_tools=True"), F.when(issues != "", F.concat(F.lit("issues: "), issues)))
    return evaluations.withColumn("observation", text.bounded(parts, most))


def normalised(results: DataFrame) -> DataFrame:
    """result_id, position, chunk_id, source, text_snippet: the evidence of tool results (result_id, text, source, citations).

    Citations with a body count, the snippet before the text before the body; a result that has no citations at all is one
    piece of evidence itself, if it has text.
    """
    from corvane.functions import text

    body = lambda c: F.coalesce(*[F.nullif(text.strip(c[k]), F.lit("")) for k in ("text_snippet", "text", "body")])
    blank = lambda c: F.coalesce(c, F.lit(""))
    cited = F.transform("citations", lambda c: F.struct(blank(c["chunk_id"]).alias("chunk_id"), F.coalesce(F.nullif(c["source"], F.lit("")), c["doc_id"], F.lit("")).alias("source"), body(c).alias("text_snippet")))
    own = F.array(F.struct(F.lit("").alias("chunk_id"), blank(F.col("source")).alias("source"), F.nullif(text.strip(F.col("text")), F.lit("")).alias("text_snippet")))
    pieces = F.filter(F.when(F.size("citations") > 0, cited).otherwise(own), lambda c: c["text_snippet"].isNotNull())
    return results.select("result_id", F.posexplode(pieces).alias("position", "c")).select("result_id", "position", "c.*")


def checked(answers: DataFrame, asked: DataFrame, chunks: DataFrame, least: int = 2) -> DataFrame:
    """The verdict on each of ``answers`` (answer_id, text) by the evidence that it names in ``asked`` (answer_id, asked_id), of which each may be a
    part of a chunk's id: answer_id, n_found, n_missing, n_sentences, n_unsupported, score, passed.

    Ids are resolved once for all answers; a chunk that an answer names twice counts once, and an id that no chunk has is missing.
    """
    resolved = resolve_ids(asked.select("asked_id"), chunks.select("chunk_id")).select("asked_id", "chunk_id")
    # few rows as a table of their own, to which texts need not be moved
    named = staged(asked.select("answer_id", "asked_id").distinct().join(resolved, "asked_id"), "named")
    met = named.where("chunk_id is not null").select("answer_id", "chunk_id").distinct().join(chunks.select("chunk_id", "text"), "chunk_id")
    weak = support(answers, met.select("answer_id", "text")).groupBy("answer_id").agg(F.count_if("unsupported").alias("n_unsupported"))
    found = met.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_found"), F.count_if(text.section_kind(F.lit(""), F.col("text")).isNotNull()).alias("n_references"))
    missing = named.where("chunk_id is null").groupBy("answer_id").agg(F.countDistinct("asked_id").alias("n_missing"))
    facts = answers.select("answer_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"), text.has_citation(F.col("text")).alias("cited"))
    facts = facts.join(weak, "answer_id", "left").join(found, "answer_id", "left").join(missing, "answer_id", "left").na.fill(0)
    return verdicts(facts, least).select("answer_id", "n_found", "n_missing", "n_sentences", "n_unsupported", "score", "passed")


# How a tool result is summed up.
ERROR_MARK, IMAGE_NOTE, CUT_MARK = "[error]", ("[含 ", " 张图，未展开]"), "…[truncated]"


def capped(body: Column, most: int) -> Column:
    """A text of more than ``most`` characters cut, with a mark; 0 is no bound."""
    if not most:
        return body
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most - 13), F.lit(CUT_MARK))).otherwise(body)


def result_summary(content: Column, is_error: Column, most: int = 0) -> Column:
    """A tool's result (array of struct type, text) as one text: a mark if it is an error, its texts, and how many images it has."""
    from corvane.functions import text

    texts = F.transform(F.filter(content, lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0)), lambda b: b["text"])
    n_images = F.size(F.filter(content, lambda b: b["type"] == "image"))
    none = F.array().cast("array<string>")
    note = F.when(n_images > 0, F.concat(F.lit(IMAGE_NOTE[0]), n_images.cast("string"), F.lit(IMAGE_NOTE[1])))
    mark = F.when(F.coalesce(is_error, F.lit(False)), F.array(F.lit(ERROR_MARK))).otherwise(none)
    parts = F.concat(mark, F.coalesce(texts, none), F.when(note.isNotNull(), F.array(note)).otherwise(none))
    return capped(text.strip(F.array_join(parts, " ")), most)


def trace_text(steps: DataFrame, by: str = "task_id", most: int = 4_000) -> DataFrame:
    """``by`` and trace: the steps (by, position, tool_name, summary) of each task, a line each, up to ``most`` characters."""
    line = F.concat(F.coalesce("tool_name", F.lit("")), F.lit(": "), F.coalesce("summary", F.lit("")))
    order = Window.partitionBy(by).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    # lines that begin behind the bound need not be gathered, but one tells that there are more
    near = steps.withColumn("line", line).withColumn("before", F.coalesce(F.sum(F.length("line") + 1).over(order), F.lit(0))).where(F.col("before") <= most + 1)
    joined = near.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("s"))
    return joined.select(by, capped(F.array_join(F.col("s.line"), "\n"), most).alias("trace"))
