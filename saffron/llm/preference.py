"""Preference formatting of chosen and rejected conversations.

Turns carry (pair, side, turn, role, text). The longest common prefix of turns
of both sides is rendered once as prompt; the turns after it are the completions
of either side, of which only the assistant's words count in the loss. All steps
work on turns, each with its place in the text of its part, so no conversation is
ever held in one row or task until ``records``; ``pair_digests`` gives the same
record of a pair by digests, lengths and masks.

Defined results: a turn number that stands on several rows is one turn of all
their words, in the order of role and text; null roles and texts count as empty;
turns without a pair or number are left out; a pair with one side missing has no
prompt, so that side is a completion as a whole and ``complete`` is false. Other
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .mixing import prefix_sums
from .skew import join_groups

OPEN, SHUT = "<|{role}|>\n", "\n<|end|>\n"


def rendered(role: Column, text: Column) -> Column:
    head = OPEN.split("{role}")
    return F.concat(F.lit(head[0]), role, F.lit(head[1]), text, F.lit(SHUT))


def preference_turns(turns: DataFrame) -> DataFrame:
    """(pair, part, turn, role, rendered, loss, start, stop, complete) of turns (pair, side, turn, role, text).

    ``part`` is prompt, chosen or rejected; a prompt turn stands once for its pair.
    ``start`` and ``stop`` tell the turn's characters in the text of its part.
    """
    clean = turns.where("pair is not null and turn is not null and side in ('chosen', 'rejected')").select("pair", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    clean = durable(clean, "turns")
    side = lambda s: F.count_if(F.col("side") == s)
    # Turns are equal if each role and text stands equally often on both sides.
    each = clean.groupBy("pair", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(side("chosen").alias("c"), side("rejected").alias("r"))
    split = each.groupBy("pair").agg(F.min(F.when(F.col("c") != F.col("r"), F.col("turn"))).alias("split"), ((F.sum("c") > 0) & (F.sum("r") > 0)).alias("complete"), (F.sum("c") + F.sum("r")).alias("n"))
    placed = join_groups(clean, split, "pair", "n", clean.count())
    prompt = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    kept = placed.where(~prompt | (F.col("side") == "chosen")).select(
        "pair", F.when(prompt, "prompt").otherwise(F.col("side")).alias("part"), "turn", "role", rendered(F.col("role"), F.col("text")).alias("rendered"),
        F.when(~prompt & (F.col("role") == "assistant"), 1).otherwise(0).alias("loss"), "complete",
    )
    sized = kept.withColumns({"_chars": F.length("rendered").cast("long"), "_tie": F.monotonically_increasing_id()})
    summed = prefix_sums(sized, [F.col(c).asc() for c in ("pair", "part", "turn", "role", "rendered", "_tie")], {"_before": "_chars"}, "places")
    first = summed.groupBy("pair", "part").agg(F.min("_before").alias("_first"), F.count(F.lit(1)).alias("_n"))
    key = F.concat_ws(":", F.col("pair").cast("string"), "part")
    whole = join_groups(summed.withColumn("_key", key), first.select(key.alias("_key"), "_first", "_n"), "_key", "_n", summed.count())
    start = F.col("_before") - F.col("_first")
    return whole.select("pair", "part", "turn", "role", "rendered", "loss", start.alias("start"), (start + F.col("_chars")).alias("stop"), "complete")


PARTS = ("prompt", "chosen", "rejected")


def _of(part: str) -> Column:
    return F.col("part") == part


def _mask(part: str) -> Column:
    """The (start, stop) of the characters of a completion that count in the loss."""
    return F.array_sort(F.collect_list(F.when(_of(part) & (F.col("loss") == 1), F.struct("start", "stop"))))


def records(parts: DataFrame) -> DataFrame:
    """(pair, prompt, chosen, rejected, chosen_mask, rejected_mask, complete), one row a pair.

    A record holds its whole pair, so its longest text must fit in memory.
    """
    text = lambda part: F.array_join(F.array_sort(F.collect_list(F.when(_of(part), F.struct("start", "rendered"))))["rendered"], "")
    return parts.groupBy("pair").agg(*(text(p).alias(p) for p in PARTS), *(_mask(p).alias(f"{p}_mask") for p in PARTS[1:]), F.first("complete").alias("complete"))


def pair_digests(parts: DataFrame) -> DataFrame:
    """(pair, complete, and of each part its turns, characters and digest, and both masks), one row a pair.

    The record of ``records`` without its texts: a row grows with the turns of its
    pair, not with their length. A digest is the SHA-256 of the turns' SHA-256 bytes
    in order, of nothing for an empty part; a mask lists start:stop, comma-joined.
    """
    narrow = parts.select("pair", "part", "complete", "loss", "start", "stop", F.sha2(F.col("rendered").cast("binary"), 256).alias("sha"))
    columns = [F.first("complete").alias("complete")]
    for part in PARTS:
        shas = F.array_sort(F.collect_list(F.when(_of(part), F.struct("start", "sha"))))["sha"]
        columns += [F.count_if(_of(part)).alias(f"{part}_turns"), F.coalesce(F.max(F.when(_of(part), F.col("stop"))), F.lit(0)).cast("long").alias(f"{part}_chars"), F.sha2(F.unhex(F.array_join(shas, "")), 256).alias(f"{part}_sha256")]
    for part in PARTS[1:]:
        columns.append(F.array_join(F.transform(_mask(part), lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",").alias(f"{part}_mask"))
    return narrow.groupBy("pair").agg(*columns)


def counterparts(conversations: DataFrame) -> DataFrame:
    """Each conversation up to its last assistant turn as the chosen side of a pair that carries its id.

    The rejected side is the same conversation with another one's last answer in that
    turn, so both completions end with an answer. The table holds no preferences of its
    own, and answers to other questions are worse ones. In the order of the digests of
    answers, then of the MD5 of ids, the first conversation after all that answer alike
    gives its answer to the first of these, the next one to the next, in a circle: an
    answer always differs. Conversations without an assistant turn, and all of them if
    they all answer alike, give no pair.
    """
    conv = conversations.select(F.col("conv_id").cast("long").alias("pair"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("pair is not null and turn is not null")
    last = conv.where("role = 'assistant'").groupBy("pair").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    answers = last.select("pair", F.col("last.turn").alias("until"), F.col("last.text").alias("answer"), F.sha2(F.col("last.text").cast("binary"), 256).alias("_sha"), F.md5(F.col("pair").cast("string").cast("binary")).alias("_hash"), F.lit(1).cast("long").alias("_one"))
    answers = durable(prefix_sums(answers, [F.col(c).asc() for c in ("_sha", "_hash", "pair")], {"_rank": "_one"}, "answers"), "ranked-answers")
    n = answers.count()
    alike = answers.groupBy("_sha").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_alike"))
    own = join_groups(answers.select("pair", "until", "_sha", "_rank"), alike, "_sha", "_alike", n).where(F.col("_alike") < n)
    others = F.lit(n) - F.col("_alike")
    taken = F.pmod(F.col("_first") + F.col("_alike") + F.pmod(F.col("_rank") - F.col("_first"), others), F.lit(n))
    given = durable(own.select("pair", "until", taken.alias("_rank")).join(answers.select("_rank", "answer"), "_rank").select("pair", "until", "answer"), "given-answers")
    sizes = conv.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).join(given.select("pair", "until"), "pair")
    reached = join_groups(conv, sizes, "pair", "n", conv.count()).where("turn <= until")
    as_side = lambda df, s: df.select("pair", F.lit(s).alias("side"), "turn", "role", "text")
    worse = given.select("pair", F.col("until").alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    return as_side(reached, "chosen").unionByName(as_side(reached.where("turn < until").select(*conv.columns).unionByName(worse), "rejected"))
