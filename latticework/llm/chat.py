"""Chat formatting of preference pairs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: One turn as text; {role} and {text} are filled in.
OPEN, CLOSE = ("<|", "|>\n"), "\n"


def escaped(text: Column) -> Column:
    """text in which nothing reads as a turn's header: a backslash more stands in ``<|``, whatever backslashes are in it already, so one taken out gives the text back."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def _parts(t: Column) -> list[Column]:
    """A turn's header, text and end; null role or text count as empty."""
    return [F.concat(F.lit(OPEN[0]), escaped(t["role"]), F.lit(OPEN[1])), escaped(t["text"]), F.lit(CLOSE)]


def _turn() -> Column:
    return F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def format_pairs(pairs: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per row of (pair_id, c, r): pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask.

    c and r are arrays of turns in order, with role and text. The common prefix is the longest run of places at which role and text agree in both (null
    equals null, the turns' numbers don't count). It is rendered once, as prompt; chosen and rejected are what follows, and their masks give for each of its turns three
    spans [characters, 1 or 0]: its header (0: a role is given, not learned), its text and its end (1 where the turn is ``learn``'s: what to say, and to stop). Spans add up to
    the completion. Markers within texts and roles are escaped, so no text can pass for a turn. A side that is a prefix of the other leaves an empty completion with an empty mask.
    """
    bare = lambda k: F.transform(k, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(k)
    pairs = pairs.select("pair_id", bare("c"), bare("r"))
    both = F.least(F.size("c"), F.size("r"))
    agree = F.transform(F.slice("c", 1, both), lambda t, i: t.eqNullSafe(F.get(F.col("r"), i)))
    first = F.array_position(agree, False)
    pairs = pairs.withColumn("n_common", F.when(first > 0, first - 1).otherwise(both.cast("long")).cast("int"))
    rest = lambda k: F.slice(k, F.col("n_common") + 1, F.size(k))
    show = lambda a: F.concat_ws("", F.transform(a, lambda t: F.concat(*_parts(t))))

    def spans(t: Column) -> Column:
        own = F.when(t["role"] == learn, 1).otherwise(0)
        return F.array(*(F.array(F.length(part), flag) for part, flag in zip(_parts(t), (F.lit(0), own, own), strict=True)))

    mask = lambda a: F.flatten(F.transform(a, spans))
    return pairs.select(
        "pair_id",
        "n_common",
        show(F.slice("c", 1, F.col("n_common"))).alias("prompt"),
        show(rest("c")).alias("chosen"),
        show(rest("r")).alias("rejected"),
        mask(rest("c")).alias("chosen_mask"),
        mask(rest("r")).alias("rejected_mask"),
    )


def preference_pairs(chosen: DataFrame, rejected: DataFrame, learn: str = "assistant") -> DataFrame:
    """format_pairs of two tables of turns (pair_id, turn, role, text), the two conversations of each pair.

    Turns are put in order of (turn, role, text) and numbered. A pair with only one side has all its turns as completion, and an empty other side. Rows
    without pair_id are left out. Repeated turns are turns. Empty tables give no pairs; other columns are ignored.
    Each pair is one row of two arrays, no larger than its two conversations; pairs, not conversations, are spread over tasks.
    """

    def side(df: DataFrame, number: int) -> DataFrame:
        return df.filter("pair_id is not null").select("pair_id", F.lit(number).alias("side"), _turn().alias("t"))

    def turns(number: int) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("side") == number, F.col("t"))))

    return format_pairs(side(chosen, 0).union(side(rejected, 1)).groupBy("pair_id").agg(turns(0).alias("c"), turns(1).alias("r")), learn)


def swapped_pairs(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """Pairs made from conversations, (pair_id, c, r): each conversation's turns, and its turns before its last answer with another's last answer.

    turns: (conv_id, turn, role, text), put in order of (turn, role, text). The last answer is ``learn``'s turn with the largest number, of equals the largest text
    (null is smallest). The other conversation is the one whose id differs in the last bit; where it has no answer, or isn't there, the rejected side ends before
    the answer. Conversations without an answer are whole on both sides. Turns without number come first. Rows without conv_id are left out; repeated turns are turns.
    A conversation is one row; turns are shuffled once, and beside them one answer of each conversation.
    """
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), _turn().alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("c"))
    answer = F.when(F.col("t.role") == learn, F.struct("t.turn", "t.text"))
    others = rows.groupBy("conv_id").agg(F.max(answer).alias("a")).filter("a is not null")
    others = others.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.struct("a.text").alias("other"))
    own = F.array_max(F.transform(F.filter("c", lambda t: t["role"] == learn), lambda t: F.struct(t["turn"].alias("turn"), t["text"].alias("text"))))
    pairs = whole.withColumn("last", own).join(others, "conv_id", "left")
    before = F.filter("c", lambda t: F.col("last").isNull() | F.coalesce(t["turn"] < F.col("last.turn"), t["turn"].isNull()))
    instead = F.struct(F.col("last.turn").alias("turn"), F.lit(learn).alias("role"), F.col("other.text").alias("text"))
    swapped = F.when(F.col("last").isNotNull() & F.col("other").isNotNull(), F.array_sort(F.concat(before, F.array(instead)))).otherwise(before)
    return pairs.select(F.col("conv_id").alias("pair_id"), "c", swapped.alias("r"))


def op7_preference_format(spark, sf_dir: str) -> DataFrame:
    """Each conversation is a pair: its turns are chosen, rejected are those with another conversation's last answer.

    Masks as text: characters:flag of each span, joined by spaces.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    pairs = format_pairs(swapped_pairs(turns))
    flat = lambda k: F.array_join(F.transform(k, lambda m: F.concat_ws(":", m[0].cast("string"), m[1].cast("string"))), " ").alias(k)
    return pairs.select("pair_id", "n_common", "prompt", "chosen", "rejected", flat("chosen_mask"), flat("rejected_mask"))


OP7_SQL = r"""
WITH w AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
 a AS (SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) AS k FROM w WHERE role = 'assistant') WHERE k = 1),
 s AS (SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM w
   UNION ALL SELECT w.conv_id, 1, w.turn, w.role, w.text FROM w LEFT JOIN a ON w.conv_id = a.conv_id WHERE a.conv_id IS NULL OR coalesce(w.turn < a.turn, w.turn IS NULL)
   UNION ALL SELECT a.conv_id, 1, a.turn, 'assistant', b.text FROM a JOIN a b ON b.conv_id = xor(a.conv_id, 1)),
 e AS (SELECT *, '<|' || regexp_replace(coalesce(role, ''), '<(\\*)\|', '<\\\1|', 'g') || '|>' || chr(10) AS head, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS body,
       CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS own FROM s),
 t AS (SELECT pair_id, side, role, text, head || body || chr(10) AS shown, length(head) || ':0 ' || length(body) || ':' || own || ' 1:' || own AS spans,
       row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM e),
 same AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.n, r.n) AS n,
       c.n IS NOT NULL AND r.n IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
     FROM (SELECT * FROM t WHERE side = 0) c FULL JOIN (SELECT * FROM t WHERE side = 1) r ON c.pair_id = r.pair_id AND c.n = r.n),
 k AS (SELECT pair_id, CAST(coalesce(min(n) FILTER (NOT same) - 1, max(n)) AS INTEGER) AS n_common FROM same GROUP BY pair_id)
SELECT k.pair_id, k.n_common,
  coalesce(string_agg(shown, '' ORDER BY n) FILTER (side = 0 AND n <= n_common), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY n) FILTER (side = 0 AND n > n_common), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY n) FILTER (side = 1 AND n > n_common), '') AS rejected,
  coalesce(string_agg(spans, ' ' ORDER BY n) FILTER (side = 0 AND n > n_common), '') AS chosen_mask,
  coalesce(string_agg(spans, ' ' ORDER BY n) FILTER (side = 1 AND n > n_common), '') AS rejected_mask
FROM t JOIN k ON t.pair_id = k.pair_id GROUP BY k.pair_id, k.n_common
"""
