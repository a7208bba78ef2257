"""Actions on regions, redacted text, and the vault of tokens that restores it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.functions.text import context_snippet
from inkveil.lexicon.words import TOKEN_LETTERS
from inkveil.operators.keys import join_nulls, numbered
from inkveil.sources.ledger import TokenLedger

#: Short tokens per letter; numbers are dealt by a permutation of this range, so they never collide. Later ones are wide.
SPACE, STEP, SHIFT = 100_000, 61_803, 27_182
TOKEN = r"\[[A-Z][0-9]{5}\]|\[ANON_[A-Z_]+_[A-F0-9]{6,12}\]"


def token_letter(kind: Column) -> Column:
    out = F.lit("U")
    for k, v in TOKEN_LETTERS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def free_ranks(vault: DataFrame | None, cursors: dict[str, tuple[int, int]], letters: list[str], spark: SparkSession) -> DataFrame:
    """letter, number (from 0) and rank of the short ranks from the letter's cursor on that no stored token has.

    At most SPACE rows a letter."""
    first = spark.createDataFrame([(k, cursors.get(k, (0, 0))[0]) for k in letters], "letter string, short long")
    ranks = first.where(F.col("short") < SPACE).select("letter", F.explode(F.sequence(F.col("short"), F.lit(SPACE - 1).cast("long"))).alias("rank"))
    if vault is not None:
        number = F.regexp_extract("token_string", r"^\[[A-Z]([0-9]{5})\]$", 1)
        held = vault.where(number != "").select(F.substring("token_string", 2, 1).alias("letter"), F.pmod((number.cast("long") - SHIFT) * pow(STEP, -1, SPACE), F.lit(SPACE)).alias("rank"))
        ranks = ranks.join(held.distinct(), ["letter", "rank"], "left_anti")
    order = Window.partitionBy("letter").orderBy("rank")
    return ranks.select("letter", (F.row_number().over(order) - 1).cast("long").alias("number"), "rank")


def wide_after(vault: DataFrame | None) -> dict[str, int]:
    """For each letter, the number after the greatest wide one stored."""
    if vault is None:
        return {}
    digits = F.regexp_extract("token_string", r"^\[ANON_[A-Z]_([A-F0-9]{12})\]$", 1)
    rows = vault.where(digits != "").groupBy(F.substring("token_string", 7, 1).alias("letter")).agg(F.max(F.conv(digits, 16, 10).cast("long")).alias("most"))
    return {r.letter: r.most + 1 for r in rows.collect()}  # a row a letter


def mint_tokens(regions: DataFrame, vault: DataFrame | None = None, ledger: TokenLedger | None = None) -> DataFrame:
    """Regions with action TOKENIZE and their tokens: a letter for the type and five digits,
    or [ANON_letter_number], with twelve hex digits, once the short ones are used up.

    Numbers follow the order of the regions within their letter, run through a permutation, and pass over
    those that the vault holds (minted or imported). With a ledger they are reserved there first: numbers of tokens that
    were deleted, or that another writer reserved, are not used either. Regions without document or page
    get tokens as others do."""
    spark = regions.sparkSession
    wanted = regions.where("action = 'TOKENIZE'").withColumn("letter", token_letter(F.col("pii_type")))
    wanted = numbered(wanted, "letter", ["doc_id", "page_number", "start", "end", "ord"])
    needs = {r.letter: r.n for r in wanted.groupBy("letter").agg(F.count("*").alias("n")).collect()}  # a row a letter
    if not needs:
        return wanted.withColumn("token_string", F.lit("")).drop("letter", "number")
    stored_wide = wide_after(vault)

    def ends(now: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
        need = spark.createDataFrame(list(needs.items()), "letter string, n long")
        free = free_ranks(vault, now, list(needs), spark).join(F.broadcast(need), "letter").where("number < n")
        used = {r.letter: r for r in free.groupBy("letter").agg(F.count("*").alias("n"), (F.max("rank") + 1).alias("end")).collect()}
        out = {}
        for k, n in needs.items():
            short, wide = now.get(k, (0, 0))
            taken = used[k].n if k in used else 0
            out[k] = (used[k].end if taken == n else SPACE, max(wide, stored_wide.get(k, 0)) + n - taken)
        return out

    now = ledger.reserve(ends) if ledger else {}
    wide = spark.createDataFrame([(k, max(now.get(k, (0, 0))[1], stored_wide.get(k, 0))) for k in needs], "letter string, wide long")
    free = free_ranks(vault, now, list(needs), spark)
    shorts = free.groupBy("letter").agg(F.count("*").alias("shorts"))
    ranked = wanted.join(free, ["letter", "number"], "left").join(F.broadcast(wide), "letter").join(F.broadcast(shorts), "letter", "left")  # a row a letter
    digits = F.pmod(F.col("rank") * STEP + SHIFT, F.lit(SPACE))
    short = F.concat(F.lit("["), "letter", F.lpad(digits.cast("string"), 5, "0"), F.lit("]"))
    later = F.col("wide") + F.col("number") - F.coalesce("shorts", F.lit(0))
    long_ = F.concat(F.lit("[ANON_"), "letter", F.lit("_"), F.lpad(F.hex(later), 12, "0"), F.lit("]"))
    return ranked.withColumn("token_string", F.when(F.col("rank").isNotNull(), short).otherwise(long_)).drop("letter", "number", "rank", "wide", "shorts")


def redact(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Pages with their text redacted: REMOVE gives ---, TOKENIZE the token; other regions stay.

    Regions of a page are spliced in one pass over their sorted list; of overlapping ones the first holds. Pages and
    regions without a document or page number meet each other; a region to tokenize without a token is removed."""
    r = regions.where("action IN ('REMOVE', 'TOKENIZE')")
    cut = F.struct("start", "end", F.when(F.col("action") == "TOKENIZE", F.coalesce("token_string", F.lit("---"))).otherwise("---").alias("by"), ((F.col("action") == "TOKENIZE") & F.col("token_string").isNotNull()).alias("is_token"))
    cuts = r.groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_list(cut)).alias("cuts"))
    joined = join_nulls(pages.select(F.col("doc_id").cast("string"), F.col("page_number").cast("long"), "text"), cuts, ["doc_id", "page_number"], "left")
    none = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"), F.lit(0).alias("tokens"), F.lit(0).alias("removed"))

    def splice(s: Column, c: Column) -> Column:
        free = c["start"] >= s["at"]
        part = F.concat(s["done"], F.substring(F.col("text"), s["at"] + 1, c["start"] - s["at"]), c["by"])
        return F.struct(F.when(free, part).otherwise(s["done"]).alias("done"), F.when(free, c["end"]).otherwise(s["at"]).alias("at"), (s["tokens"] + F.when(free & c["is_token"], 1).otherwise(0)).alias("tokens"), (s["removed"] + F.when(free & ~c["is_token"], 1).otherwise(0)).alias("removed"))

    s = F.aggregate(F.coalesce("cuts", F.array().cast(cuts.schema["cuts"].dataType)), none, splice)
    out = joined.withColumn("s", s)
    rest = F.substring(F.col("text"), F.col("s.at") + 1, F.length("text"))
    return out.select("doc_id", "page_number", F.concat("s.done", rest).alias("text"), F.col("s.tokens").alias("tokens_created"), F.col("s.removed").alias("regions_removed"))


def vault_rows(tokens: DataFrame, pages: DataFrame, created_at: Column) -> DataFrame:
    """Rows for the vault: one per token, with the text around it (of the first of pages that repeat); tokens
    without a page keep their row, without a snippet."""
    t = pages.select(F.col("doc_id").cast("string"), F.col("page_number").cast("long"), F.col("text").alias("page_text"))
    t = t.groupBy("doc_id", "page_number").agg(F.min("page_text").alias("page_text"))
    joined = join_nulls(tokens, t, ["doc_id", "page_number"], "left")
    return joined.select(F.sha2("token_string", 256).alias("token_id"), "token_string", F.col("text").alias("original_text"), "pii_type", F.col("doc_id").alias("source_document"), context_snippet(F.col("page_text"), F.col("start"), F.col("end")).alias("context_snippet"), created_at.alias("created_at"))


def detokenize(pages: DataFrame, vault: DataFrame) -> DataFrame:
    """Pages with their tokens resolved; tokens that the vault lacks stay.

    tokens_replaced counts occurrences less the distinct unresolved ones; `unresolved` is sorted. Pages without a
    document or page number are resolved as others are; a null text stays null."""
    found = pages.withColumn("tokens", F.regexp_extract_all("text", F.lit(TOKEN), 0))
    each = found.select("doc_id", "page_number", F.explode(F.array_distinct("tokens")).alias("token_string"))
    each = each.join(vault.select("token_string", "original_text"), "token_string", "left")
    pair = F.struct("token_string", "original_text")
    known = each.groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_list(F.when(F.col("original_text").isNotNull(), pair))).alias("known"), F.sort_array(F.collect_list(F.when(F.col("original_text").isNull(), F.col("token_string")))).alias("unresolved"))
    out = join_nulls(found, known, ["doc_id", "page_number"], "left")
    text = F.aggregate(F.coalesce("known", F.array().cast(known.schema["known"].dataType)), F.col("text"), lambda s, p: F.replace(s, p["token_string"], p["original_text"]))
    lost = F.coalesce("unresolved", F.array().cast("array<string>"))
    return out.select("doc_id", "page_number", text.alias("text"), (F.size("tokens") - F.size(lost)).alias("tokens_replaced"), lost.alias("unresolved"))


def export_json(vault: DataFrame) -> DataFrame:
    """The vault as JSON lines, newest first within each file; wrap with version 2 on the way out."""
    return vault.select(F.to_json(F.struct(*vault.columns)).alias("value"))


def import_tokens(vault: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, counts): new tokens once each; those known or repeated are skipped, broken ones are errors."""
    ok = F.col("token_id").isNotNull() & F.col("token_string").isNotNull() & F.col("original_text").isNotNull() & F.col("pii_type").isin(list(TOKEN_LETTERS)) & F.col("created_at").isNotNull()
    good = new.where(ok)
    fresh = good.join(vault.select("token_string"), "token_string", "left_anti").dropDuplicates(["token_string"]).select(*vault.columns)
    totals = new.agg(F.count("*").alias("all"), F.count_if(F.coalesce(ok, F.lit(False))).alias("good")).crossJoin(fresh.agg(F.count("*").alias("imported")))  # one row each
    return fresh, totals.select("imported", (F.col("good") - F.col("imported")).alias("skipped"), (F.col("all") - F.col("good")).alias("errors"))


def set_action(regions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Regions with the action of `chosen` (region_id, action); siblings of a linked group of their document follow.

    A region's own change comes first, then that of the sibling with the least region_id; of changes that
    repeat an id the least counts."""
    once = chosen.groupBy("region_id").agg(F.min("action").alias("__new"))
    out = regions.join(once, "region_id", "left")
    new = F.col("__new")
    if "linked_group" in regions.columns:
        told = regions.join(once, "region_id").where("linked_group IS NOT NULL").groupBy("doc_id", "linked_group").agg(F.min_by("__new", "region_id").alias("__told"))
        out = join_nulls(out, told, ["doc_id", "linked_group"], "left")
        new = F.coalesce("__new", "__told")
    return out.withColumn("action", F.coalesce(new, "action")).select(*regions.columns)
