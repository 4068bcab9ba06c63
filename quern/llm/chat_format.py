"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

DataFrame functions only, and a row for each rendered turn, so that no conversation is gathered in
one row; records() puts the rows of a pair together. Each conversation is in exactly one pair:

1. prefix: every prefix of turns is named by running sums of hashes of its turns, those of repeated
   turns of one number added up in any order. The conversations whose deepest shared prefix is the
   same differ in the turn after it; they are paired two by two, in shares and then across them.
2. branch: a conversation that is left branches at its last assistant turn; what it says there is
   chosen, and the last answer of another conversation, never an equal text, is rejected.
3. none: without an assistant turn after another turn, or another answer, it is all prompt.

The longest common prefix of both sides is the prompt, rendered once; turns after it are the
completions. Only what the assistant says in a completion is trained.

Texts are joined to the pairs once. Sums are made before each shuffle, and the running sums of a
conversation of any length are made in blocks of turns.

Cases: null ids are one conversation of their own and a null turn comes last, both with null in the
result; null texts and roles count as empty; turns that share a number are compared as a bag; copies
of a conversation, and one that is a prefix of another, branch; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import written

_NO_CONVERSATION = -(1 << 63)
_LAST_TURN = (1 << 63) - 1
END = "<|end|>\n"
ASSISTANT = "assistant"
#: Turn numbers of a block of running sums.
BLOCK_TURNS = 512
#: Distinct answers from which on they are dealt by a hexadecimal digit of their hash, then by two, and so on.
RING = 5000


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def conversation_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) without nulls."""
    c = conversations
    return c.select(
        F.coalesce(c[conv_col].cast("long"), F.lit(_NO_CONVERSATION)).alias("conv"),
        F.coalesce(c[turn_col].cast("long"), F.lit(_LAST_TURN)).alias("turn"),
        F.coalesce(c[role_col], F.lit("")).alias("role"),
        F.coalesce(c[text_col], F.lit("")).alias("text"),
    )


def _wide(k: int, *columns: str) -> Column:
    return F.xxhash64(*columns, F.lit(k)).cast("decimal(38,0)")


def _signatures(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv", "turn").agg(F.count("*").alias("n"), *[F.sum(_wide(k, "role", "text")).alias(f"s{k}") for k in range(2)])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, turn, p0, p1): the name of the prefix of each conversation up to each of its turns."""
    signed = _signatures(turns).select("conv", "turn", F.floor(F.col("turn") / BLOCK_TURNS).alias("block"), *[_wide(k, "turn", "n", "s0", "s1").alias(f"h{k}") for k in range(2)])
    blocks = signed.groupBy("conv", "block").agg(*[F.sum(f"h{k}").alias(f"h{k}") for k in range(2)])
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of several blocks have any.
    offsets = blocks.select("conv", "block", *[F.sum(f"h{k}").over(earlier).alias(f"o{k}") for k in range(2)]).where("o0 IS NOT NULL")
    own = Window.partitionBy("conv", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    sums = signed.join(offsets, ["conv", "block"], "left")
    return sums.select("conv", "turn", *[(F.sum(f"h{k}").over(own) + F.coalesce(f"o{k}", F.lit(0))).alias(f"p{k}") for k in range(2)])


def pairs_by_prefix(named: DataFrame) -> DataFrame:
    """(chosen, rejected, split) of distinct conversations with the longest shared prefix; `split` is the last turn of it."""
    name = F.struct("turn", "p0", "p1")
    whole = named.groupBy("conv").agg(F.max(name).alias("whole"))
    # Copies are one conversation, the smallest.
    one = whole.groupBy("whole").agg(F.min("conv").alias("conv"))
    named = named.join(one, "conv")
    shared = named.groupBy("turn", "p0", "p1").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    deepest = named.join(shared, ["turn", "p0", "p1"]).groupBy("conv", "whole").agg(F.max(name).alias("prefix")).where("prefix <> whole")

    def two_by_two(left: DataFrame, *keys: str) -> DataFrame:
        nth = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("conv")) - 1) / 2)
        return left.withColumn("nth", nth).groupBy(*keys, "nth").agg(F.min("conv").alias("chosen"), F.max("conv").alias("rejected"))

    share = F.substring(F.sha2(F.col("conv").cast("string"), 256), 1, 2)
    first = written(two_by_two(deepest.select("conv", "prefix", share.alias("share")), "prefix", "share"), "pairs")
    # At most one of each share is left.
    second = two_by_two(first.where("chosen = rejected").select(F.col("chosen").alias("conv"), "prefix"), "prefix")
    both = first.select("chosen", "rejected", "prefix").unionByName(second.select("chosen", "rejected", "prefix"))
    return both.where("chosen <> rejected").select("chosen", "rejected", F.col("prefix.turn").alias("split"))


def branches(turns: DataFrame, paired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For conversations not in `paired` (conv): (conv, branch, rejected), and the answers (rejected, answer_turn, text).

    branch: the turn at which a conversation branches; null, as is `rejected`, where it can't.
    """
    said = F.when(F.col("role") == ASSISTANT, F.struct("turn", "text"))
    # The last answer of each conversation is found before any text is dealt by it.
    ends = turns.groupBy("conv").agg(F.min("turn").alias("first"), F.max(said).alias("x")).join(paired, "conv", "left_anti")
    answers = written(ends.select("conv", "first", "x.turn", "x.text", F.sha2("x.text", 256).alias("answer")), "answers")
    distinct = answers.where("answer IS NOT NULL").groupBy("answer").agg(F.min("conv").alias("conv"))
    n = distinct.count()
    digits = sum(n >= RING * 16**k for k in range(16))
    order = Window.partitionBy(F.substring("answer", 1, digits)).orderBy("answer")
    after = F.coalesce(F.lead("conv").over(order), F.first("conv").over(order))
    ring = distinct.select("answer", "conv", after.alias("rejected")).where("conv <> rejected").select("answer", "rejected")
    donors = answers.select(F.col("conv").alias("rejected"), F.col("turn").alias("answer_turn"), "text")
    own = answers.where("first < turn").select("conv", F.col("turn").alias("branch"), "answer").join(ring, "answer").drop("answer")
    return answers.select("conv").join(own, "conv", "left"), donors


def _pair_rows(turns: DataFrame, sides: DataFrame) -> DataFrame:
    """The turns of each side; sides: (conv, side, chosen, rejected, pairing, split), a turn up to which all is prompt."""
    before = F.col("split").isNull() | (F.col("turn") <= F.col("split"))
    part = F.when(F.col("side") == "rejected", F.when(~before, "rejected")).otherwise(F.when(before, "prompt").otherwise("chosen"))
    return turns.join(sides, "conv").withColumn("part", part).where("part IS NOT NULL").select("chosen", "rejected", "pairing", "part", "turn", "role", "text")


def _id(name: str) -> Column:
    return F.when(F.col(name) != _NO_CONVERSATION, F.col(name)).alias(f"{name}_id")


def _rendered(rows: DataFrame) -> DataFrame:
    trained = (F.col("part") != "prompt") & (F.col("role") == ASSISTANT)
    start = F.length(header(F.col("role")))
    return rows.select(
        _id("chosen"), _id("rejected"), "pairing", "part", F.when(F.col("turn") != _LAST_TURN, F.col("turn")).alias("turn"), "role",
        F.concat(header(F.col("role")), "text", F.lit(END)).alias("rendered"),
        F.when(trained, start).otherwise(0).cast("long").alias("trained_from"),
        F.when(trained, start + F.length("text") + len(END)).otherwise(0).cast("long").alias("trained_to"),
    )


def splits(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chosen, rejected, split): the last turn of the longest common prefix of each of `pairs`; null where they are equal.

    One below the first turn number at which the signatures differ.
    """
    signed = _signatures(turns).select("conv", "turn", F.struct("n", "s0", "s1").alias("signature"))
    sides = [pairs.join(signed, pairs[side] == signed["conv"]).select("chosen", "rejected", "turn", *[F.when(F.lit(side == other), F.col("signature")).alias(f"of_{other}") for other in ("chosen", "rejected")]) for side in ("chosen", "rejected")]
    both = sides[0].unionByName(sides[1]).groupBy("chosen", "rejected", "turn").agg(F.max("of_chosen").alias("a"), F.max("of_rejected").alias("b"))
    return both.groupBy("chosen", "rejected").agg((F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("turn"))) - 1).alias("split"))


def given_pairs(conversations: DataFrame, pairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of preference_rows() for labelled `pairs` (chosen, rejected) of conversation ids."""
    turns = conversation_turns(conversations, conv_col, turn_col, role_col, text_col)
    pairs = pairs.select(*[F.coalesce(pairs[c].cast("long"), F.lit(_NO_CONVERSATION)).alias(c) for c in ("chosen", "rejected")]).distinct()
    split = splits(turns, pairs).withColumn("pairing", F.lit("given"))
    sides = [split.select(F.col(side).alias("conv"), F.lit(side).alias("side"), "chosen", "rejected", "pairing", "split") for side in ("chosen", "rejected")]
    return _rendered(_pair_rows(turns, sides[0].unionByName(sides[1].where("split IS NOT NULL"))))


def preference_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each rendered turn of the pair of each conversation.

    part: prompt, chosen or rejected; rendered: the turn as text; trained_from and trained_to: the
    code points of it that the loss counts, both 0 in a masked turn. pairing: prefix, branch or none.
    """
    turns = conversation_turns(conversations, conv_col, turn_col, role_col, text_col)
    pairs = written(pairs_by_prefix(written(prefixes(turns), "prefixes")), "pairs")
    paired = pairs.select(F.explode(F.array("chosen", "rejected")).alias("conv"))
    branched, answers = branches(turns, paired)
    branched = written(branched, "branches")
    schema = ["conv", "side", "chosen", "rejected", "pairing", "split"]
    sides = [pairs.select(F.col(side).alias("conv"), F.lit(side).alias("side"), "chosen", "rejected", F.lit("prefix").alias("pairing"), "split") for side in ("chosen", "rejected")]
    alone = branched.select("conv", F.lit("chosen").alias("side"), F.col("conv").alias("chosen"), "rejected", F.when(F.col("branch").isNull(), "none").otherwise("branch").alias("pairing"), (F.col("branch") - 1).alias("split"))
    both = written(sides[0].unionByName(sides[1]).unionByName(alone).select(*schema), "sides")
    # The answers that a branch rejects, from the conversation that gave them.
    other = branched.where("rejected IS NOT NULL").select(F.col("conv").alias("chosen"), "rejected").join(answers, "rejected")
    other = other.select("chosen", "rejected", F.lit("branch").alias("pairing"), F.lit("rejected").alias("part"), F.col("answer_turn").alias("turn"), F.lit(ASSISTANT).alias("role"), "text")
    return _rendered(_pair_rows(turns, both).unionByName(other))


def records(rows: DataFrame) -> DataFrame:
    """A row for each pair of preference_rows(): prompt, chosen and rejected as texts, and the spans of each completion that are trained.

    The turns of a pair come together in one row, so this is for pairs that fit in memory; turns of
    one number come in order of role and text.
    """

    def of(part: str) -> list[Column]:
        own = F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct(F.coalesce("turn", F.lit(_LAST_TURN)).alias("turn"), "role", "rendered", "trained_from", "trained_to"))))
        return [own.alias(part)]

    def masks(part: str) -> Column:
        begin = F.aggregate(
            part, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
            lambda a, t: F.struct((a["at"] + F.length(t["rendered"])).alias("at"), F.when(t["trained_to"] > 0, F.array_append(a["spans"], F.struct((a["at"] + t["trained_from"]).alias("start"), (a["at"] + t["trained_to"]).alias("end")))).otherwise(a["spans"]).alias("spans")),
        )
        return begin["spans"].alias(f"{part}_trained")

    parts = ("prompt", "chosen", "rejected")
    rows = rows.groupBy("chosen_id", "rejected_id", "pairing").agg(*[c for p in parts for c in of(p)])
    text = [F.array_join(F.transform(p, lambda t: t["rendered"]), "").alias(p) for p in parts]
    return rows.select("chosen_id", "rejected_id", "pairing", *text, *[masks(p) for p in parts[1:]])
