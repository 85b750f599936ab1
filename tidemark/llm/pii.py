"""Personal data replaced by surrogates, with DataFrame functions alone.

Detected entities get a keyed replacement of their own kind and form: digits for digits in the same places, addresses for
addresses, family and given names in the script of the original. The replacement depends on the key and the entity's core
(the digits of a card, the address in lower case, the family name), so one entity has one surrogate in all texts, however
it is written. A given name is a core of its own, of the kind that its title's gender makes. Names are detected by their
titles; in a text with such a name, other places where its family or given name stands as a word get the same surrogate.
Names that no title precedes anywhere in their text, and forms that KINDS doesn't list, are out of reach. All cores of the corpus are
then checked: where two cores of a kind would share a surrogate, or a surrogate is itself a core of the corpus, another is
drawn, until none are. Names get longer with each draw, so they don't run out. Given names are drawn from a short list
first and from syllables afterwards, so many of them need a further draw; of other cores few do. Only texts that hold such
a core meet a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

# What is detected, in order of precedence.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++){1,8}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,}|gh[pousr]_[A-Za-z0-9]{30,})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{4}[ \-]?){3}[0-9]{4}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])",
    "ip": r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[\p{L}\p{N}])",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "phone": r"(?<![\p{L}\p{N}.\-])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![\p{L}\p{N}\-])",
    "phone abroad": r"(?<![\p{L}\p{N}.\-])\+[1-9][0-9]{0,2}(?:[ .\-]?(?:\([0-9]{1,5}\)|[0-9]{2,12}|[0-9](?=[ .\-]))){1,6}(?![\p{L}\p{N}\-])",
    "name": r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Señor|Señora|Dr|Prof|Г-н|Г-жа)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?(?![\p{L}\p{N}])",
}
#: Texts that this doesn't match hold no entity.
HINT = r"[0-9@]|::|Mr|Ms|Miss|Herr|Frau|Monsieur|Madame|Señor|Dr|Prof|Г-"
FEMALE, EITHER = r"^(?:Mrs|Ms|Miss|Frau|Madame|Señora|Г-жа)", r"^(?:Dr|Prof)"
GIVEN = {"f": ["Alma", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Hanna"], "m": ["Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo"]}
GIVEN_CYRILLIC = {"f": ["Алла", "Вера", "Дарья", "Елена"], "m": ["Антон", "Борис", "Виктор", "Глеб"]}
SYLLABLES = ["ba", "be", "da", "do", "fe", "ga", "ka", "ko", "la", "li", "ma", "mo", "na", "ne", "ra", "to"]
SYLLABLES_CYRILLIC = ["ба", "бе", "да", "до", "фе", "га", "ка", "ко", "ла", "ли", "ма", "мо", "на", "не", "ра", "то"]

PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
ROUNDS = 40


def _number(*of: Column) -> Column:
    """A number from 0 to 2^32 - 1 that the given columns decide."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *of), 256), 1, 8), 16, 10).cast("long")


def _one_of(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(entity.rlike(f"^(?:{_bare(pattern)})$"), F.lit(kind.split(" ")[0])).otherwise(out)
    return out


def _bare(pattern: str) -> str:
    """The pattern without what it says of its surroundings."""
    while "(?<!" in pattern or "(?!" in pattern:
        at = pattern.index("(?<!") if "(?<!" in pattern else pattern.index("(?!")
        pattern = pattern[:at] + pattern[pattern.index(")", at) + 1 :]
    return pattern


def core_of(kind: Column, entity: Column) -> Column:
    """What stays the same however an entity is written."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.when((F.length(digits) == 10) & ~entity.startswith("+"), digits).when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(F.concat(F.lit("+"), digits)))
        .when(kind.isin("email", "ipv6"), F.lower(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "name", F.regexp_extract(entity, r"(\p{Lu}\p{Ll}+)$", 1))
        .otherwise(entity)
    )


def given_of(kind: Column, entity: Column) -> tuple[Column, Column]:
    """The kind and core of an entity's given name; both null without one."""
    parts = F.split(entity, " ")
    has = (kind == "name") & (F.size(parts) > 2)
    gender = F.when(entity.rlike(FEMALE), F.lit("given f")).when(entity.rlike(EITHER), F.lit("given")).otherwise(F.lit("given m"))
    return F.when(has, gender), F.when(has, F.get(parts, F.lit(1)))


def _syllables(core: Column, count: Column, *seed: Column) -> Column:
    """A name of so many syllables in the script of core."""
    of = lambda values: F.transform(F.sequence(F.lit(1), count), lambda i: _one_of(values, _number(*seed, F.concat(F.lit("s"), (i - 1).cast("string")))))
    return F.initcap(F.array_join(F.when(core.rlike(r"\p{IsCyrillic}"), of(SYLLABLES_CYRILLIC)).otherwise(of(SYLLABLES)), ""))


def surrogate_given(kind: Column, core: Column, draw: Column, key: str) -> Column:
    """The surrogate of a given name, null for null: first one of the list, then syllables, one more with each draw."""
    n = _number(F.lit(key), F.lit("given"), core)
    listed = lambda of: F.when(kind == "given f", _one_of(of["f"], n)).when(kind == "given m", _one_of(of["m"], n)).otherwise(_one_of(of["f"] + of["m"], n))
    first = F.when(core.rlike(r"\p{IsCyrillic}"), listed(GIVEN_CYRILLIC)).otherwise(listed(GIVEN))
    return F.when(core.isNotNull(), F.when(draw == 0, first).otherwise(_syllables(core, draw + 2, F.lit(key), kind, draw.cast("string"), core)))


def _like(text: Column, *seed: Column, hexadecimal: Column | None = None) -> Column:
    """Other letters and digits in the places of those of text: digits, capitals, small letters each among themselves."""

    def char(c: Column, i: Column) -> Column:
        n = _number(*seed, i.cast("string"))
        small = _one_of(list("abcdefghijklmnopqrstuvwxyz"), n)
        digit = F.when((i == 0) & (c != "0"), n % 9 + 1).otherwise(n % 10).cast("string")
        plain = F.when(c.rlike("[0-9]"), digit).when(c.rlike(r"\p{Lu}"), F.upper(small)).when(c.rlike(r"\p{L}"), small).otherwise(c)
        if hexadecimal is None:
            return plain
        digit = _one_of(list("0123456789abcdef"), n)
        return F.when(hexadecimal & c.rlike("[0-9A-Fa-f]"), F.when(text.rlike("[A-F]"), F.upper(digit)).otherwise(digit)).otherwise(plain)

    return F.array_join(F.transform(F.split(text, ""), char), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a number modulo 10."""
    weights = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(weights, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def surrogate_core(kind: Column, core: Column, draw: Column, key: str) -> Column:
    """The core of the surrogate. Cards keep whether their check digit is right."""
    seed = (F.lit(key), kind, draw.cast("string"), core)
    n = lambda tag: _number(*seed, F.lit(tag))
    digits = _like(core, *seed)
    front = F.substring(digits, 1, 15)
    checked = F.concat(front, ((10 - _luhn(F.concat(front, F.lit("0")))) % 10).cast("string"))
    ip = F.concat_ws(".", (n("a") % 223 + 1).cast("string"), *((n(t) % 256).cast("string") for t in "bcd"))
    at = F.locate("@", core)
    email = F.concat(_like(F.substring_index(core, "@", 1), *seed), F.lit("@mail"), (n("h") % 1_000_000).cast("string"), F.lit(".example.org"))
    return (
        F.when(kind == "card", F.when(_luhn(core) == 0, checked).otherwise(digits))
        .when((kind == "phone") & core.startswith("+"), F.concat(F.substring(core, 1, 3), _like(F.substring(core, 4, 20), *seed)))
        .when((kind == "phone") | (kind == "ssn"), digits)
        .when(kind == "ipv6", _like(core, *seed, hexadecimal=F.lit(True)))
        .when(kind == "ip", ip)
        .when((kind == "email") & (at > 0), email)
        .when(kind == "name", _syllables(core, draw + 5, *seed))
        .when(kind.startswith("given"), surrogate_given(kind, core, draw, key))
        .when(kind == "secret", F.concat(F.regexp_extract(core, "^(AKIA|sk-|gh[pousr]_|)", 1), _like(F.regexp_replace(core, "^(?:AKIA|sk-|gh[pousr]_)", ""), *seed, hexadecimal=core.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"))))
        .otherwise(F.concat(F.substring(core, 1, 2), _like(F.substring(core, 3, 64), *seed)))
    )


def _written(kind: Column, entity: Column, surrogate: Column, given: Column) -> Column:
    """The surrogate in the form of the entity."""

    def placed(c: Column, i: Column) -> Column:
        after = F.length(F.regexp_replace(F.substr(entity, i + 1), "[^0-9A-Z]", ""))  # letters and digits from here on
        spot = F.substr(surrogate, F.length(surrogate) - after + 1, F.lit(1))
        return F.when(c.rlike("[0-9A-Z]") & (after <= F.length(surrogate)), spot).otherwise(c)

    name = F.concat_ws(" ", F.get(F.split(entity, " "), F.lit(0)), given, surrogate)
    return F.when(kind.isin("card", "ssn", "iban") | (kind == "phone"), F.array_join(F.transform(F.split(entity, ""), placed), "")).when(kind == "name", name).otherwise(surrogate)


def _mentions(gap: Column) -> Column:
    """What lies between entities, with the surrogates of the text's names in place of these; words of no name stay."""
    names = F.filter("__steps", lambda x: x["kind"] == "name")
    given = F.filter(names, lambda x: x["given"].isNotNull())
    words = F.concat(F.transform(names, lambda x: x["core"]), F.transform(given, lambda x: F.get(F.split(x["entity"], " "), F.lit(1))))
    new = F.concat(F.transform(names, lambda x: x["surrogate"]), F.transform(given, lambda x: x["given"]))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_distinct(words), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    put = F.transform(F.regexp_extract_all(gap, pattern, F.lit(0)), lambda w: F.get(new, (F.array_position(words, w) - 1).cast("int")))
    joined = F.array_join(F.flatten(F.zip_with(F.split(gap, pattern, -1), put, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.when(F.size(names) > 0, joined).otherwise(gap)


def detected(docs: DataFrame, text_col: str = "text") -> Column:
    """The entities of a text in order; none for null."""
    text = F.col(text_col).cast("string")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def redrawn(docs: DataFrame, key: str, text_col: str = "text") -> tuple[DataFrame, int]:
    """(kind, core, draw) of the cores whose first surrogate could not stay, and how many they are."""
    entity = docs.select(F.explode(detected(docs, text_col)).alias("entity")).select(kind_of(F.col("entity")).alias("kind"), "entity")
    given_kind, given = given_of(F.col("kind"), F.col("entity"))
    both = F.array(F.struct("kind", core_of(F.col("kind"), F.col("entity")).alias("core")), F.struct(given_kind.alias("kind"), given.alias("core")))
    cores = entity.select(F.inline(both)).where("core IS NOT NULL").distinct()
    draw = lambda df, n: df.select("kind", "core", F.lit(n).alias("draw"), surrogate_core(F.col("kind"), F.col("core"), F.lit(n), key).alias("surrogate"))
    settled, first = None, cut(draw(cores, 0))
    now, moved = first, None
    for n in range(1, ROUNDS):
        known = first.select("kind", F.col("core").alias("surrogate"))
        taken = now.join(known, ["kind", "surrogate"], "left_semi")
        shared = now.groupBy("kind", "surrogate").agg(F.min("core").alias("keeps"), F.count("*").alias("times")).where("times > 1")
        again = now.join(shared, ["kind", "surrogate"]).where("core <> keeps").select("kind", "core").union(taken.select("kind", "core"))
        if settled is not None:
            again = again.union(now.join(settled, ["kind", "surrogate"], "left_semi").select("kind", "core"))
        again = cut(again.distinct())
        left = again.count()
        stays = now.join(again, ["kind", "core"], "left_anti")
        moved = stays.where("draw > 0") if moved is None else moved.union(stays.where("draw > 0"))
        if not left:
            return moved.select("kind", "core", "draw"), (0 if n == 1 else moved.count())
        settled = stays.select("kind", "surrogate") if settled is None else settled.union(stays.select("kind", "surrogate"))
        now = cut(draw(again, n))
    raise RuntimeError("pii: surrogates run out")


def replaced(docs: DataFrame, key: str = "tidemark", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with entities in text_col replaced, and the column n_entities (names' further mentions not counted).

    Null and empty texts stay as they are, as do texts without entities. Rows are never dropped or merged; repeated rows
    get the same text each. The key decides all surrogates. A column n_entities that docs has gives way.
    """
    docs = docs.drop("n_entities")
    moved, n = redrawn(docs, key, text_col)
    found = docs.withColumn("__found", detected(docs, text_col)).withColumn("__draws", F.lit(None).cast("map<int,int>"))
    if n:
        have = cut(found.where(F.size("__found") > 0).withColumn("__row", F.monotonically_increasing_id()))
        each = have.select("__row", F.posexplode("__found").alias("at", "entity")).withColumn("kind", kind_of(F.col("entity")))
        given_kind, given = given_of(F.col("kind"), F.col("entity"))  # their draws are at -1, -2 and so on
        both = F.array(F.struct("at", "kind", core_of(F.col("kind"), F.col("entity")).alias("core")), F.struct((-1 - F.col("at")).alias("at"), given_kind.alias("kind"), given.alias("core")))
        later = each.select("__row", F.inline(both)).where("core IS NOT NULL").join(moved, ["kind", "core"])
        draws = later.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("at", "draw"))).alias("__draws"))  # of one row
        have = have.drop("__draws").join(draws, "__row", "left").drop("__row")
        found = found.where(F.size("__found") == 0).unionByName(have)
    steps = F.transform("__found", lambda e, i: F.struct(e.alias("entity"), kind_of(e).alias("kind"), F.coalesce(F.element_at("__draws", i), F.lit(0)).alias("draw"), F.coalesce(F.element_at("__draws", -1 - i), F.lit(0)).alias("given_draw")))
    steps = F.transform(steps, lambda x: F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), x["draw"].alias("draw"), core_of(x["kind"], x["entity"]).alias("core"), surrogate_given(*given_of(x["kind"], x["entity"]), x["given_draw"], key).alias("given")))
    steps = F.transform(steps, lambda x: F.struct(*(x[c].alias(c) for c in ("entity", "kind", "core", "given")), surrogate_core(x["kind"], x["core"], x["draw"], key).alias("surrogate")))
    found = found.withColumn("__steps", steps)
    new = F.transform("__steps", lambda x: _written(x["kind"], x["entity"], x["surrogate"], x["given"]))
    gaps = F.transform(F.split(F.col(text_col).cast("string"), PATTERN, -1), _mentions)
    joined = F.array_join(F.flatten(F.zip_with(gaps, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    out = found.withColumn(text_col, F.when(F.size("__found") > 0, joined).otherwise(F.col(text_col)))
    return out.select(*docs.columns, F.size("__found").alias("n_entities"))
