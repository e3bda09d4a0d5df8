"""Exact duplicates by content-defined chunk recipes.

A text is cut into chunks where its own content says so, so equal passages give equal chunks
wherever they stand. Chunks are deduplicated to identifiers; a text becomes its recipe, the ordered
list of chunk identifiers; texts are equal when their recipes are. Texts are read once and never
shuffled: what moves are fixed-size facts per chunk and one row per distinct recipe.

Identifiers are verified: chunks share one only if SHA-256, size and a second, independent hash
agree, so a collision of one hash gives two identifiers. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrade.llm.shared import cut, numbered, quoted
from sitegrade.operators.keyed import attach

SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Chunking:
    """A chunk ends after characters whose code points modulo ``modulus`` are ``ending``, once it
    has ``smallest`` characters, and at ``largest`` characters at the latest.

    Endings are rarer than ``smallest`` is long, so two texts that differ soon share ends again.
    """

    smallest: int = 128
    largest: int = 8192
    modulus: int = 8
    ending: tuple[int, ...] = (5, 4, 1)

    def _characters(self, remainder: int) -> str:
        codes = range(0x21, 0x250)
        return "".join(f"\\x{{{c:x}}}" for c in codes if c % self.modulus == remainder)

    @property
    def pattern(self) -> str:
        end = "".join(f"[{self._characters(r)}]" for r in self.ending)
        return f"(?s).{{{self.smallest},{self.largest}}}?(?<={end})|.{{1,{self.largest}}}"


def normalised(text: str) -> str:
    """SQL: the text without white space; null counts as empty."""
    return f"regexp_replace(coalesce({text}, ''), '{_escaped(SPACES)}', '')"


def _escaped(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def recipes(docs: DataFrame, text: str = "text", chunking: Chunking = Chunking()) -> DataFrame:
    """Add ``chars`` (code points of the text), ``text_sha256``, ``recipe`` and ``recipe_key``.

    ``recipe`` is array<struct<digest, size, probe>> in text order, ``recipe_key`` its SHA-256 (binary).
    """
    plain = docs.selectExpr("*", f"{normalised(quoted(text))} as _plain")
    chunks = f"regexp_extract_all(_plain, '{_escaped(chunking.pattern)}', 0)"
    facts = "named_struct('digest', unhex(sha2(c, 256)), 'size', octet_length(c), 'probe', xxhash64(c))"
    listed = plain.selectExpr(
        "*",
        f"length(coalesce({quoted(text)}, '')) as chars",
        "sha2(_plain, 256) as text_sha256",
        f"transform({chunks}, c -> {facts}) as recipe",
    ).drop("_plain")
    parts = "transform(recipe, c -> concat(hex(c.digest), ':', c.size, ':', c.probe))"
    return listed.selectExpr("*", f"unhex(sha2(array_join({parts}, ','), 256)) as recipe_key")


def chunk_dictionary(listed: DataFrame) -> DataFrame:
    """One row per distinct chunk with ``chunk_id``. Uses are combined before the shuffle."""
    chunks = listed.groupBy("digest", "size", "probe").agg(F.count("*").alias("uses"))
    return cut(numbered(chunks, "chunk_id"), "chunks")


def exact_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    chunking: Chunking = Chunking(),
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they agree apart from white space. The row with the most code points in
    its original text stays, then the smallest id; a null id comes last. Of rows that agree in
    both, one stays. Null and empty texts are equal to each other. ``carry`` names the columns of
    ``docs`` in the result (the id always is); an empty table gives an empty result. Columns of
    ``docs`` that have the name of a result column are replaced by it.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    wanted = [c for c in dict.fromkeys([doc_id, *(carry or [])]) if c.lower() not in added]
    source = docs.select(
        F.struct(*[F.col(quoted(c)) for c in wanted]).alias("_row"),
        F.col(quoted(doc_id)).alias("_id"),
        F.col(quoted(text)).alias("_text"),
    )
    rows = cut(numbered(recipes(source, "_text", chunking).drop("_text"), "_no"), "recipes")
    out = attach(rows.drop("recipe", "chars", "_id"), _decided(rows), ["recipe_key"])
    return out.selectExpr(
        "_row.*", "keep_id", "n as group_size", "_no = _keep as kept", "text_sha256"
    )


def _decided(rows: DataFrame) -> DataFrame:
    """Per ``recipe_key``: ``keep_id``, ``most`` (its code points), ``_keep`` (its number) and ``n``.

    ``rows``: what :func:`recipes` gives, with ``_id`` and ``_no``, stored.
    """
    # One row per distinct recipe; a group of copies shrinks to a row per task before the shuffle.
    best = "min(struct(-chars as less, _id is null as nameless, _id as id, _no as no))"
    stats = rows.groupBy("recipe_key").agg(
        F.expr(best).alias("best"),
        F.count("*").alias("n"),
        F.expr("any_value(recipe)").alias("recipe"),
    )
    # Chunks carry the number of their recipe, a quarter of its key.
    stats = cut(numbered(stats, "recipe_no"), "distinct")
    listed = stats.selectExpr("recipe_no", "posexplode(recipe) as (pos, chunk)")
    listed = listed.select("recipe_no", "pos", "chunk.*")
    identified = attach(
        listed, chunk_dictionary(listed).drop("uses"), ["digest", "size", "probe"]
    )
    lists = identified.groupBy("recipe_no").agg(
        F.expr("transform(array_sort(collect_list(struct(pos, chunk_id))), c -> c.chunk_id)").alias("ids")
    )
    named = stats.drop("recipe").join(lists, "recipe_no", "left")
    named = named.selectExpr("recipe_key", "best", "n", "coalesce(ids, array()) as ids")
    # Equal lists are equal texts. Recipes are distinct here, so a list has one key.
    groups = named.groupBy("ids").agg(
        F.min("best").alias("best"), F.sum("n").alias("n"), F.collect_set("recipe_key").alias("keys")
    )
    return groups.selectExpr(
        "explode(keys) as recipe_key", "best.id as keep_id", "-best.less as most", "best.no as _keep", "n"
    )


def chunk_store(docs: DataFrame, text: str = "text", chunking: Chunking = Chunking()) -> DataFrame:
    """Each distinct chunk once: ``digest``, ``chunk`` (text) and ``uses``. Moves every chunk once."""
    pieces = docs.selectExpr(
        f"explode(regexp_extract_all({normalised(quoted(text))}, '{_escaped(chunking.pattern)}', 0)) as chunk"
    )
    return pieces.groupBy("chunk").agg(F.count("*").alias("uses")).selectExpr(
        "unhex(sha2(chunk, 256)) as digest", "chunk", "uses"
    )


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunking: Chunking = Chunking()
) -> DataFrame:
    """The rows that stay, with the columns of ``docs``.

    Decisions are made on narrow facts; documents are read again, not stored, and move once. A row
    is found by the SHA-256 of its normalised text, its code points and its id. Of rows that agree
    in all three, any one stays; these ties shrink to a row per task before their shuffle.
    """
    id_, body = quoted(doc_id), quoted(text)
    narrow = docs.selectExpr(f"{id_} as _id", f"{body} as _text")
    rows = cut(numbered(recipes(narrow, "_text", chunking).drop("_text"), "_no"), "recipes")
    facts = attach(rows.drop("recipe"), _decided(rows), ["recipe_key"])
    best = facts.filter("_id <=> keep_id and chars = most").selectExpr(
        "text_sha256 as _sha", "chars as _chars", "_id is null as _nameless",
        "coalesce(cast(_id as string), '') as _name",
    )
    keys = best.columns
    best = cut(best.groupBy(*keys).agg(F.count("*").alias("_copies")), "best")
    ties = cut(best.filter("_copies > 1"), "ties")

    found = docs.select(
        F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"),
        F.expr(f"sha2({normalised(body)}, 256)").alias("_sha"),
        F.expr(f"length(coalesce({body}, ''))").alias("_chars"),
        F.expr(f"{id_} is null").alias("_nameless"),
        F.expr(f"coalesce(cast({id_} as string), '')").alias("_name"),
    )
    single = attach(found, best.filter("_copies = 1"), keys).filter("_copies is not null")
    tied = attach(found, ties, keys).filter("_copies is not null")
    one = tied.groupBy(*keys).agg(F.any_value("_row").alias("_row"))
    return single.select("_row.*").unionAll(one.select("_row.*"))
