"""Surrogates for personal data: found entities are replaced by keyed ones of the same kind, script and format.

A surrogate is a keyed permutation of the entity's shape (of very long entities a keyed shift): digits stay digits, upper case stays upper case, vowels of a name stay vowels of
its script, an address octet stays an octet, a card number keeps the remainder of its check digit, and titles, country codes and top-level
domains stay as they are.  Equal entities therefore get equal surrogates in all documents, and different ones different surrogates.
Everything is a Column expression.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import Carried, Written

#: Titles before a name with the gender they tell, and given names by gender.
TITLES = {"Mr.": "m", "Mrs.": "f", "Ms.": "f", "Miss": "f", "Dr.": "", "Prof.": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f",
          "Señor": "m", "Señora": "f", "Господин": "m", "Госпожа": "f"}
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Thomas Daniel Paul Peter Hans Karl Pierre Jean Carlos Pedro".split(),
    ("f", "latin"): "Mary Linda Susan Karen Nancy Lisa Emily Laura Anna Maria Julia Sophie Claire Carmen Lucia Elena".split(),
    ("m", "cyrillic"): "Иван Пётр Павел Олег Юрий Борис Игорь Андрей".split(),
    ("f", "cyrillic"): "Анна Мария Ольга Елена Ирина Вера Дарья Нина".split(),
}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
#: Kind and pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-](?:[\p{L}\p{N}\-.]*[\p{L}\p{N}\-])?\.\p{L}{2,}+",
    "keyed": r"(?<=(?i:token|secret|password|passwd|api_?key)[ ]{0,2}[=:][ ]{0,2}[\x22\x27]?)[A-Za-z0-9_+/\-]{12,}+",
    "access": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9\-]{10,}+)(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    "hexup": r"(?<![A-Za-z0-9])[0-9A-F]{32,}+(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}(?:[ .\-]?\(\d{1,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|(?:[ .\-]\d{2,4}){3,5})|\(\d{3}\)[ ]?\d{3}[ .\-]\d{4}|\d{3}-\d{3}-\d{4})(?!\d|[.\-]\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\dA-Za-z])\d(?:[ \-]?\d){12,18}(?![\dA-Za-z]|[.\-]\d)",
    "name": rf"(?<![\p{{L}}])(?:{'|'.join(t.replace('.', r'[.]') for t in TITLES)})[ ]{_NAME}(?:[ ]{_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_KEYS = "(?i)token|secret|password|passwd|api_?key"
_HINTS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", *TITLES]
_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SOUNDS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ"]
#: Letters of other scripts, by their code ranges: accented Latin, Greek and Cyrillic, lower and upper case.
_OTHERS = ["".join(chr(c) for c in range(a, b + 1) if chr(c).isalpha()) for a, b in ((0xDF, 0xFF), (0xC0, 0xDE), (0x3B1, 0x3C9), (0x391, 0x3A9), (0x430, 0x44F), (0x410, 0x42F))]
#: Entities beyond this length are shifted by a keyed digest of the whole instead of a permutation, in linear time; the collision check covers them.
LONG = 256
_ALPHABETS = {"hex": ["0123456789abcdef"], "hexup": ["0123456789ABCDEF"], "name": _SOUNDS}
ROUNDS = 8
#: Surrogates of shapes with at least this many members, half of them unused, are also kept apart from all entities of the corpus.
WIDE = 2.0**20


def likely(text: Column) -> Column:
    """A cheap test that no text with an entity fails: the full pattern runs on the others only."""
    out = text.rlike("[0-9@]") | text.rlike(_KEYS)
    for hint in _HINTS:
        out |= text.contains(hint)
    return out


def entities(text: Column) -> Column:
    """The entities of a text in their order; an empty array where there are none."""
    return F.when(likely(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(entity: Column) -> Column:
    out = F.lit("keyed")
    for kind in reversed([k for k in PATTERNS if k != "keyed"]):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _held(kind: Column, entity: Column) -> tuple[Column, Column]:
    """How many leading and trailing characters stay: country code, title, the mark of an access key; top-level domain, check digit."""
    front = F.when(kind == "phone", F.length(F.regexp_extract(entity, r"^\+\d{1,3}", 0))) \
        .when(kind == "access", F.length(F.regexp_extract(entity, r"^(?:AKIA|ASIA|gh._|sk-|xox.-)", 0))) \
        .when(kind == "name", F.length(F.regexp_extract(entity, r"^\S+ ", 0))).otherwise(0)
    back = F.when(kind == "email", F.length(F.regexp_extract(entity, r"\.\p{L}+$", 0))).when(kind == "card", 1).otherwise(0)
    return front, back


def _cells(kind: Column, entity: Column) -> Column:
    """The entity as an array of ``v`` (number), ``n`` (how many there are), ``a`` (their alphabet), ``c`` (the piece itself), ``k`` (its rank).

    Pieces that stay, separators too, have ``n`` 0 and no part in the permutation: a number gets the same digits however it is spaced.
    """
    front, back = _held(kind, entity)

    def cell(c, i, alphabets, free):
        n, v, a = F.lit(0), F.lit(0), F.lit("")
        for letters in alphabets:
            found = free & F.contains(F.lit(letters), c)
            n, v, a = F.when(found, len(letters)).otherwise(n), F.when(found, F.instr(F.lit(letters), c) - 1).otherwise(v), F.when(found, letters).otherwise(a)
        return F.struct(v.cast("int").alias("v"), n.cast("int").alias("n"), a.alias("a"), c.alias("c"))

    def text_cells(alphabets):
        # the split makes one piece per character; the numbers around it are computed once per entity
        return _once(F.struct(F.split(entity, "").alias("p"), front.alias("f"), (F.length(entity) - back).alias("b")),
                     lambda e: F.transform(e["p"], lambda c, i: cell(c, i, alphabets, (i >= e["f"]) & (i < e["b"]))))

    octets = F.transform(F.split(entity, r"\."), lambda c: F.struct(
        F.try_to_number(c, F.lit("999")).cast("int").alias("v"), F.lit(256).alias("n"), F.lit("").alias("a"), c.alias("c")))
    out = text_cells([_DIGITS, _LOW, _UP, *_OTHERS])
    for name, alphabets in _ALPHABETS.items():
        out = F.when(kind == name, text_cells(alphabets)).otherwise(out)
    counted = F.when(kind == "ip", octets).otherwise(out)
    return _once(counted, lambda at: F.transform(at, lambda x, i: F.struct(
        x["v"].alias("v"), x["n"].alias("n"), x["a"].alias("a"), x["c"].alias("c"),
        F.when(F.size(at) > LONG, i).otherwise(F.size(F.filter(F.slice(at, 1, i), lambda y: y["n"] > 0))).alias("k"))))


def _luhn(text: Column) -> Column:
    """The check sum of a card number, modulo 10."""
    digits = F.reverse(F.split(F.regexp_replace(text, r"\D", ""), ""))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def shape_of(kind: Column, cells: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.array_join(F.transform(cells, lambda x: F.when(x["n"] > 0, F.concat(F.lit("<"), x["n"], F.lit(">"))).otherwise(x["c"])), ""))


def space_of(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(1.0), lambda a, x: a * F.greatest(x["n"], F.lit(1)))


def _permuted(kind: Column, cells: Column, key: str) -> Column:
    """A Feistel network over the cells: those of even and of odd rank in turn are shifted by a keyed digest of the others."""
    def rest(at, side):
        return F.array_join(F.transform(F.filter(at, lambda x: (x["n"] > 0) & (x["k"] % 2 != side)), lambda x: F.concat(x["v"], F.lit("/"), x["n"])), ",")

    def step(at, r):
        digest = F.sha2(F.concat_ws("|", F.lit(key), kind, r, F.size(F.filter(at, lambda x: x["n"] > 0)), rest(at, r % 2)), 256)
        return _once(digest, lambda d: F.transform(at, lambda x: F.struct(
            F.when((x["n"] > 0) & (x["k"] % 2 == r % 2), F.pmod(x["v"] + F.pmod(F.xxhash64(d, x["k"]), F.greatest(x["n"], F.lit(1)).cast("long")), F.greatest(x["n"], F.lit(1)).cast("long")))
             .otherwise(x["v"].cast("long")).cast("int").alias("v"), x["n"].alias("n"), x["a"].alias("a"), x["c"].alias("c"), x["k"].alias("k"))))

    def shifted(at):
        digest = F.sha2(F.concat_ws("|", F.lit(key), kind, F.array_join(F.transform(at, lambda x: x["c"]), ""), F.array_join(F.transform(at, lambda x: x["v"]), ",")), 256)
        return _once(digest, lambda d: F.transform(at, lambda x: F.struct(
            F.when(x["n"] > 0, F.pmod(x["v"] + F.pmod(F.xxhash64(d, x["k"]), F.greatest(x["n"], F.lit(1)).cast("long")), F.greatest(x["n"], F.lit(1)).cast("long")))
             .otherwise(x["v"].cast("long")).cast("int").alias("v"), x["n"].alias("n"), x["a"].alias("a"), x["c"].alias("c"), x["k"].alias("k"))))

    permuted = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), cells, step)
    return F.when(F.size(cells) > LONG, shifted(cells)).otherwise(permuted)


def _written_out(kind: Column, cells: Column) -> Column:
    pieces = F.transform(cells, lambda x: F.when(x["n"] == 256, x["v"].cast("string")).when(x["n"] > 0, F.substring(x["a"], x["v"] + 1, F.lit(1))).otherwise(x["c"]))
    return F.when(kind == "ip", F.array_join(pieces, ".")).otherwise(F.array_join(pieces, ""))


def _given(entity: Column, out: Column, key: str) -> Column:
    """A known given name becomes another of its gender and script, chosen with the family name's surrogate."""
    found = out
    name, family = F.regexp_extract(entity, r"^\S+ (\S+) \S+$", 1), F.regexp_extract(out, r"^\S+ \S+ (\S+)$", 1)
    shift = F.xxhash64(F.lit(key), family)
    for names in GIVEN.values():
        listed = F.array(*map(F.lit, names))
        chosen = F.element_at(listed, (F.pmod(F.array_position(listed, name) + F.pmod(shift, F.lit(len(names) - 1)), F.lit(len(names))) + 1).cast("int"))
        found = F.when(F.array_contains(listed, name), F.concat(F.regexp_extract(entity, r"^\S+ ", 0), chosen, F.lit(" "), family)).otherwise(found)
    return found


def with_surrogates(table: DataFrame, key: str) -> DataFrame:
    """Replace ``surrogate`` (at first the entity) in ``kind, entity, surrogate`` by its image under the permutation."""
    kind = F.col("kind")
    at = table.withColumn("cells", _cells(kind, F.col("surrogate")))
    at = at.withColumn("out", _written_out(kind, _permuted(kind, F.col("cells"), key)))
    bare = F.concat(F.expr("substring(out, 1, length(out) - 1)"), F.lit("0"))
    check = F.concat(F.expr("substring(out, 1, length(out) - 1)"), F.pmod(_luhn(F.col("surrogate")) - _luhn(bare), F.lit(10)).cast("string"))
    out = F.when(kind == "card", check).when(kind == "name", _given(F.col("surrogate"), F.col("out"), key)).otherwise(F.col("out"))
    return at.withColumn("surrogate", out).drop("cells", "out")


def surrogates(found: DataFrame, key: str, written: Written) -> DataFrame:
    """``entity, surrogate`` for the distinct entities of ``found`` (``entity``).

    The permutation alone keeps entities apart.  The check that follows walks on, in rounds of joins over the few rows concerned, from a
    surrogate that another row has too or that is itself an entity of the corpus.  Shapes that are narrow, or more than half used, are
    left to the permutation, which is one-to-one within a shape.
    """
    kinds = found.distinct().withColumn("kind", kind_of(F.col("entity")))
    cells = _cells(F.col("kind"), F.col("entity"))
    shaped = kinds.withColumn("cells", cells).select("kind", "entity", shape_of(F.col("kind"), F.col("cells")).alias("shape"), space_of(F.col("cells")).alias("space"))
    shaped = written.table(shaped)
    used = shaped.groupBy("shape").agg(F.count("*").alias("used"))
    # names also change their given name by list, so they can meet outside their shape and are always walked
    wide = (F.col("kind") == "name") | ((F.col("space") >= WIDE) & (F.col("used") * 2 < F.col("space")))
    start = shaped.join(used, "shape").select("kind", "entity", F.col("entity").alias("surrogate"), wide.alias("wide"))
    table = with_surrogates(start, key)
    table = written.table(table)
    for turn in range(1, 65):
        taken = table.select(F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        first = table.groupBy("surrogate").agg(F.min("entity").alias("first"))
        bad = table.filter("wide").join(taken, "surrogate", "left").join(first, "surrogate").filter(F.col("real") | (F.col("entity") != F.col("first"))).select("kind", "entity", "surrogate", "wide")
        bad = written.table(bad)
        if bad.isEmpty():
            written.drop(bad)
            return table.select("entity", "surrogate")
        moved = with_surrogates(bad, f"{key}#{turn}" if turn > 8 else key)
        table = written.table(table.join(bad.select("entity"), "entity", "left_anti").unionByName(moved))
    raise ValueError("surrogates still collide after 64 rounds")


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def replace_entities(docs: DataFrame, key: str = "surrogate key", text_col="text") -> tuple[DataFrame, Carried]:
    """The carried rows of ``docs`` with ``p_text`` (rewritten) and ``p_count`` (entities replaced), and what brings the names back."""
    written = Written(docs.sparkSession)
    carried = Carried(docs)
    text = carried.col(text_col).cast("string")
    holding = carried.frame.filter(likely(text) & text.rlike(ANY))
    # copies of a text are one row here, so neither a frequent text nor its entities meet in one task
    texts = holding.select(_text_key(text).alias("key"), entities(text).alias("found")).groupBy("key").agg(F.first("found").alias("found"))
    texts = written.table(texts)
    listed = texts.select("key", F.posexplode("found").alias("at", "entity"))
    table = surrogates(listed.select("entity"), key, written)
    new = listed.join(table, "entity").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias("new"))
    rows = holding.withColumn("p_key", _text_key(text)).join(new, F.col("p_key") == F.col("key"))
    filled = F.zip_with(F.split(text, ANY, -1), F.transform("new", lambda x: x["surrogate"]), lambda gap, s: F.concat(gap, F.coalesce(s, F.lit(""))))
    rows = rows.withColumns({"p_text": F.array_join(filled, ""), "p_count": F.size("new")}).drop("p_key", "key", "new")
    plain = carried.frame.filter(F.coalesce(~(likely(text) & text.rlike(ANY)), F.lit(True)))
    return rows.unionByName(plain.withColumns({"p_text": text, "p_count": F.lit(0)})), carried


def rewrite(docs: DataFrame, key: str = "surrogate key", text_col="text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text_col`` replaced; all columns stay, and ``chars_col`` gets the new number of code points.

    A null text stays null, a text without entities stays as it is, repeated rows stay repeated.
    """
    rows, carried = replace_entities(docs, key, text_col)
    replaced = {text_col: F.col("p_text")}
    if chars_col:
        replaced[chars_col] = F.length("p_text").cast(docs.schema[chars_col].dataType)
    return carried.back(rows, **replaced)


def report(docs: DataFrame, key: str = "surrogate key", id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text`` (rewritten) and ``n_entities``."""
    rows, carried = replace_entities(docs, key, text_col)
    return rows.select(carried.col(id_col).alias("doc_id"), F.col("p_text").alias("text"), F.col("p_count").cast("int").alias("n_entities"))
