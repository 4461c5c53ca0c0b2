"""Personal data in texts (DataFrame functions only).

Regular expressions propose spans. Checks confirm them: octets of addresses, Luhn for
card numbers, mod-97 for account numbers, digit counts for phones. Words of the context,
the ``CONTEXT`` characters of the text before and after a span, adjust its score.

Offsets without a function that returns them: the matches of a text and the gaps between
them (split at the same pattern) come from the same search, so a match starts where the
gaps and matches before it end. That is a running sum over the rows of one text and
kind, in place of a fold that copies a growing array.

Patterns begin where a run begins (or where the last match ended) and repeat groups
possessively. A run that can't match is then not tried again from its second character,
and a very long one needs no stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str          # texts without a match of it are not searched
    context: str       # words that raise the score
    base: bool = True
    score: float = 0.6


# The base kinds in their order; the patterns find the contract's spans.
BASE_KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         r"(?i)mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", r"(?i)\b(ip|host|server|address|addr|login)\b"),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+", r"[0-9](?:[\x20-]?[0-9]){11}",
         r"(?i)card|visa|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"(?i)phone|call|tel|mobile|fax"),
)
MORE_KINDS = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         r"[A-Z]{2}[0-9]{2}", r"(?i)iban|bank|account|konto|cuenta|compte", False, 0.7),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"-[0-9]{2}-",
         r"(?i)\bssn\b|social security", False, 0.2),
)


def luhn(digits: Column) -> Column:
    """Is the digit string a Luhn number?"""
    back = F.reverse(digits)

    def add(total, i):
        x = F.substring(back, i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Is the account number's check remainder 1? Letters count as 10 to 35."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest, c):
        return F.when(c.between("0", "9"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _confirmed(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    octets = F.forall(F.split(hit, r"\."), lambda x: F.ltrim(x, F.lit("0")).rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (F.when(kind == "ip", octets)
            .when(kind == "card", F.length(digits).between(12, 19) & luhn(digits))
            .when(kind == "phone", F.length(digits).between(9, 15))
            .when(kind == "iban", mod97(F.replace(hit, F.lit(" "), F.lit(""))))
            .when(kind == "ssn", ~hit.rlike("^(000|666|9)|-00-|-0000$")).otherwise(F.lit(True)))


def pii_spans(docs: DataFrame, more: tuple = MORE_KINDS, least: float = 0.5, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """row, id, kind, number (of the kind), base, start, end (code points, end exclusive)
    and score of every confirmed span; and one line without a kind for every row.

    Base kinds are kept at any score, the others from ``least`` on. Null texts are empty;
    repeated rows are searched each for itself; an empty table gives an empty one.
    """
    kinds = BASE_KINDS + tuple(more)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hits = rows.select("row", "id", "text", *[
        F.when(F.col("text").contains(k.hint) if k.hint == "@" else F.col("text").rlike(k.hint),
               F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).alias(f"h{i}") for i, k in enumerate(kinds)])
    gaps = hits.select("row", "id", *[f"h{i}" for i in range(len(kinds))], *[
        F.when(F.size(f"h{i}") > 0, F.split("text", k.pattern, -1)).alias(f"g{i}") for i, k in enumerate(kinds)])

    def found(i):
        def one(hit, at):
            before, after = F.get(F.col(f"g{i}"), at), F.get(F.col(f"g{i}"), at + 1)
            return F.struct(F.lit(i).alias("number"), at.alias("at"), F.length(before).alias("gap"), hit.alias("hit"),
                            F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"))
        return F.when(F.size(f"h{i}") > 0, F.transform(F.col(f"h{i}"), one)).otherwise(F.array())

    nothing = F.struct(F.lit(-1).alias("number"), F.lit(0).alias("at"), F.lit(0).alias("gap"),
                       *[F.lit(None).cast("string").alias(c) for c in ("hit", "before", "after")])
    each = (gaps.select("row", "id", F.explode(F.concat(F.array(nothing), *[found(i) for i in range(len(kinds))])).alias("x"))
            .select("row", "id", "x.*").repartition("row"))
    place = Window.partitionBy("row", "number").orderBy("at")
    upto = place.rowsBetween(Window.unboundedPreceding, 0)
    # the context goes on over neighbouring matches and their gaps; a match has a character, so CONTEXT of them are enough
    earlier = F.collect_list(F.concat("before", F.right("hit", F.lit(CONTEXT)))).over(place.rowsBetween(-CONTEXT, -1))
    later = F.collect_list(F.concat(F.left("hit", F.lit(CONTEXT)), "after")).over(place.rowsBetween(1, CONTEXT))
    context = F.concat(F.right(F.concat(F.array_join(earlier, ""), "before"), F.lit(CONTEXT)), F.lit("\n"),
                       F.left(F.concat("after", F.array_join(later, "")), F.lit(CONTEXT)))
    names, words = F.array(*[F.lit(k.name) for k in kinds]), F.array(*[F.lit(k.context) for k in kinds])
    scores, is_base = F.array(*[F.lit(k.score) for k in kinds]), F.array(*[F.lit(k.base) for k in kinds])
    placed = (each.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("hit"), F.lit(0))).over(upto)).withColumn("near", context)
              .withColumn("start", F.col("end") - F.length("hit"))
              .withColumn("kind", F.get(names, F.col("number"))).withColumn("base", F.get(is_base, F.col("number"))))
    sure = placed.where(F.col("kind").isNull() | _confirmed(F.col("kind"), F.col("hit")))
    near = F.regexp_like("near", F.get(words, F.col("number")))
    scored = sure.withColumn("score", F.get(scores, F.col("number")) + F.when(near, 0.3).otherwise(0.0))
    return (scored.where(F.col("kind").isNull() | F.col("base") | (F.col("score") >= least))
            .select("row", "id", "kind", "number", "base", F.col("start").cast("long").alias("start"),
                    F.when(F.col("kind").isNotNull(), F.col("end")).cast("long").alias("end"), "score"))


def pii_by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, found (array of start, number, kind, end, base,
    score in order of start and kind)."""
    spans = pii_spans(docs, id_col=id_col, text_col=text_col, **options)
    one = F.when(F.col("kind").isNotNull(), F.struct("start", "number", "kind", "end", "base", "score"))
    return (spans.groupBy("row", "id").agg(F.array_sort(F.collect_list(one)).alias("found"))
            .select(F.col("id").alias(id_col), "found"))
