"""10. PII [native]: surrogate generation.

Detected entities are replaced by made-up ones of the same type and format. A
surrogate is drawn by a keyed hash of its entity, so an entity has the same one
everywhere, however it is spelt; entities whose surrogates collide, or hit an
entity of the corpus, draw again until all differ. Given and family names are
drawn by themselves and keep their gender and script.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, packed, table, unpacked, written

#: The secret that surrogates are drawn by, where the caller gives none.
KEY = "ledgerline"
#: From this attempt on, mail names and secrets grow by a digit an attempt, so their room has no end.
GROWS_FROM = 4
#: Rounds without a surrogate after which a format of fixed width counts as full.
IDLE_ROUNDS = 16

#: Given names and family names by script and gender, from which name surrogates are built: fixed values.
GIVEN = {
    ("latin", "f"): ("Alma", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Hilda", "Ines", "Judith", "Klara", "Lena", "Marta", "Nora", "Olga", "Paula", "Rita", "Sonja", "Tessa", "Ursula", "Vera", "Wilma", "Yara", "Zita"),
    ("latin", "m"): ("Anton", "Bruno", "Carlo", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Nils", "Oskar", "Paul", "Rolf", "Simon", "Tom", "Ulrich", "Viktor", "Walter", "Xaver", "Yann"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Ольга"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Леонид", "Максим", "Олег"),
}
STEMS = {"latin": ("Ar", "Bel", "Cor", "Dal", "Er", "Fal", "Gar", "Hol", "Is", "Jor", "Kel", "Lor", "Mar", "Nor", "Or", "Pel"), "cyrillic": ("Ар", "Бел", "Вол", "Гор", "Дуб", "Ер", "Жар", "Зор")}
ENDS = {"latin": ("bach", "den", "feld", "gard", "hart", "ker", "lund", "man", "ner", "rick", "son", "ster", "ton", "ville", "wald", "wick"), "cyrillic": ("ов", "ин", "ев", "ко", "ук", "их", "енко", "ский")}
FEMALE = ("Mrs.", "Ms.", "Miss", "Frau", "Mme", "Madame", "Sra.", "Señora", "Г-жа")
MALE = ("Mr.", "Herr", "M.", "Monsieur", "Sr.", "Señor", "Г-н")

_NAME = "\\p{Lu}(?:\\p{L}|['\u2019-](?=\\p{L}))+"
_TITLE = "|".join(t.replace(".", "\\.") for t in (*FEMALE, *MALE))
#: Types, first match wins. Lookarounds keep longer runs of digits or letters from matching in part.
PATTERNS: dict[str, str] = {
    "email": "[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}",
    "secret": "(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api_key|apikey)\\s{0,3}[=:]\\s{0,3}(?:\"[^\"\\s]{4,}\"|'[^'\\s]{4,}'|[^\\s\"',;]{4,})",
    "aws_key": "(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": "(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": "(?<![0-9A-Za-z+])(?:\\+[0-9]{1,3}[ .-]?\\(?[0-9]{1,4}\\)?(?:[ .-]?[0-9]{2,4}){2,4}|\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "ipv4": "(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\\.[0-9])",
    # parts of a name may be joined by hyphens or apostrophes
    "name": f"(?<![\\p{{L}}])(?:{_TITLE}) {_NAME}(?: {_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What each match holds: a text without it needs no further look.
HINT = f"[0-9@]|[=:]|(?:{_TITLE}) "


def kind_of(entity: Column) -> Column:
    return F.coalesce(*[F.when(entity.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()], F.lit("secret"))


def _nibbles(secret: str, *seed: Column) -> Column:
    """128 keyed hex digits."""
    one = F.concat_ws("|", F.lit(secret), *seed)
    return F.concat(F.sha2(one, 256), F.sha2(F.concat(one, F.lit("|2")), 256))


def _number(stream: Column, at: Column, least: int, most: int) -> Column:
    """least to most, from six hex digits of the stream; it wraps around."""
    six = F.substring(stream, F.pmod(at * 3, F.lit(120)).cast("int") + 1, F.lit(6))
    return F.conv(six, 16, 10).cast("long") % (most - least + 1) + least


def _like(entity: Column, stream: Column, keep: Column, lower: str = "abcdefghijklmnopqrstuvwxyz", upper: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> Column:
    """Each character after the first `keep` becomes another of its class; punctuation, space and other letters stay."""

    def one(c: Column, i: Column) -> Column:
        pick = lambda letters: F.substring(F.lit(letters), _number(stream, i, 1, len(letters)).cast("int"), F.lit(1))
        changed = F.when(c.rlike("^[0-9]$"), pick("0123456789")).when(c.rlike("^[a-z]$"), pick(lower)).when(c.rlike("^[A-Z]$"), pick(upper)).otherwise(c)
        return F.when(i < keep, c).otherwise(changed)

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of an array of digits, the last one undoubled."""
    n = F.size(digits)
    return F.aggregate(F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)), F.lit(0), lambda a, d: a + d)


def _digits(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda d: d.cast("int"))


#: Separators of spelt numbers, and a number's country code (kept).
APART = "[ .()-]"
COUNTRY = "^(\\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}))"
FAMILY, GIVEN_F, GIVEN_M = "family", "given f", "given m"


def key_of(entity: Column, kind: Column) -> Column:
    """What all spellings of an entity share."""
    return F.when(kind == "email", F.lower(entity)).when(kind.isin("card", "phone", "iban"), F.regexp_replace(entity, APART, "")).otherwise(entity)


def _name_parts(entity: Column) -> tuple[Column, Column, Column, Column]:
    """Title, given name (or "") and family name of a titled name, and the kind of its given name."""
    title = F.regexp_extract(entity, f"^({_TITLE}) ", 1)
    names = F.split(F.substring(entity, F.char_length(title) + 2, F.char_length(entity)), " ")
    return title, F.when(F.size(names) > 1, F.get(names, F.lit(0))).otherwise(F.lit("")), F.element_at(names, -1), F.when(title.isin(*FEMALE), F.lit(GIVEN_F)).otherwise(F.lit(GIVEN_M))


def spelt(entity: Column, kind: Column, new: Column) -> Column:
    """The surrogate of a key as an entity spells it: numbers take the entity's separators, mail addresses its capitals."""

    def number(n: Column) -> Column:
        place = lambda i: F.char_length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), APART, ""))
        return F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike(APART), c).otherwise(F.substring(n, place(i), F.lit(1)))), "")

    def capitals(part: Column, old: Column) -> Column:
        return F.array_join(F.transform(F.split(part, ""), lambda c, i: F.when(F.substring(old, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")

    mail = F.concat_ws("@", *[capitals(F.substring_index(new, "@", n), F.substring_index(entity, "@", n)) for n in (1, -1)])
    return F.when(kind.isin("card", "phone", "iban") & entity.rlike(APART), number(new)).when((kind == "email") & entity.rlike("[A-Z]"), mail).otherwise(new)


def _mod_97(text: Column) -> Column:
    """Remainder of an account number as a bank takes it: letters are 10 to 35."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def surrogate(entity: Column, kind: Column, attempt: int, secret_key: str = KEY) -> Column:
    """The `attempt`th surrogate of a key. Names grow by a stem with each attempt, mail names and secrets by a digit from GROWS_FROM on."""

    def grown(s: Column) -> Column:
        return F.concat(F.lit(""), *[_number(s, F.lit(39 - 2 * j), 0, 9).cast("string") for j in range(attempt - GROWS_FROM + 1)])

    def email(s: Column) -> Column:
        local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
        host, top = F.regexp_replace(domain, "\\.[A-Za-z]+$", ""), F.regexp_extract(domain, "(\\.[A-Za-z]+)$", 1)
        # one domain has one surrogate
        return F.concat(_like(local, s, F.lit(0)), grown(s), F.lit("@"), _like(host, _nibbles(secret_key, F.lit("domain"), F.lower(domain)), F.lit(0)), top)

    def card(s: Column) -> Column:
        drawn = _like(entity, s, F.lit(1))
        body, last = F.substring(drawn, F.lit(1), F.char_length(drawn) - 1), F.substring(drawn, F.char_length(drawn), F.lit(1))
        check = (10 - _luhn_sum(_digits(F.concat(body, F.lit("0")))) % 10) % 10
        # a valid number stays valid, an invalid one invalid
        valid = _luhn_sum(_digits(entity)) % 10 == 0
        odd = F.when(last.cast("int") == check, (check + 1) % 10).otherwise(last.cast("int"))
        return F.concat(body, F.when(valid, check).otherwise(odd).cast("string"))

    def ipv4(s: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _number(s, i * 2, 1, 254).cast("string")), ".")

    def secret(s: Column) -> Column:
        head = F.regexp_extract(entity, "^([A-Za-z_]+\\s*[=:]\\s*[\"']?)", 1)
        # hexadecimal values stay so
        value = F.substring(entity, F.char_length(head) + 1, F.char_length(entity))
        new = F.when(value.rlike("^[0-9A-Fa-f]+[\"']?$"), _like(value, s, F.lit(0), "abcdef", "ABCDEF")).otherwise(_like(value, s, F.lit(0)))
        closing = F.when(head.rlike("[\"']$"), F.regexp_extract(value, "([\"']?)$", 1)).otherwise(F.lit(""))
        return F.concat(head, F.substring(new, F.lit(1), F.char_length(new) - F.char_length(closing)), grown(s), closing)

    def phone(s: Column) -> Column:
        return _like(entity, s, F.char_length(F.regexp_extract(entity, COUNTRY, 1)))

    def iban(s: Column) -> Column:
        # a valid number stays valid, an invalid one invalid
        drawn = _like(entity, s, F.lit(2))
        country, body = F.substring(entity, F.lit(1), F.lit(2)), F.substring(drawn, F.lit(5), F.char_length(drawn))
        whole = lambda number: F.concat(F.substring(number, F.lit(5), F.char_length(number)), F.substring(number, F.lit(1), F.lit(4)))
        check = 98 - _mod_97(F.concat(body, country, F.lit("00")))
        other = F.when(F.substring(drawn, F.lit(3), F.lit(2)).cast("int") == check, F.lit(0)).otherwise(F.substring(drawn, F.lit(3), F.lit(2)).cast("int"))
        return F.concat(country, F.lpad(F.when(_mod_97(whole(entity)) == 1, check).otherwise(other).cast("string"), 2, "0"), body)

    def listed(s: Column, names: tuple, at: int) -> Column:
        return F.get(F.array(*[F.lit(x) for x in names]), _number(s, F.lit(at), 0, len(names) - 1).cast("int"))

    def by_script(make: Callable[[str], Column]) -> Column:
        return F.when(entity.rlike("\\p{IsCyrillic}"), make("cyrillic")).otherwise(make("latin"))

    def stems(s: Column, script: str, at: int, n: int) -> list[Column]:
        return [F.lower(listed(s, STEMS[script], at + 2 * j)) for j in range(n)]

    def family(s: Column) -> Column:
        return F.initcap(by_script(lambda k: F.concat(*stems(s, k, 2, 2 + attempt), listed(s, ENDS[k], 0))))

    def given(s: Column, gender: str) -> Column:
        return by_script(lambda k: F.concat(listed(s, GIVEN[k, gender], 0), *stems(s, k, 2, attempt)))

    def made(s: Column) -> Column:
        return (
            F.when(kind == "email", email(s)).when(kind == "card", card(s)).when(kind == "ipv4", ipv4(s)).when(kind == "secret", secret(s)).when(kind == "phone", phone(s))
            .when(kind == FAMILY, family(s)).when(kind == GIVEN_F, given(s, "f")).when(kind == GIVEN_M, given(s, "m"))
            .when(kind == "aws_key", _like(entity, s, F.lit(4))).when(kind == "iban", iban(s)).otherwise(_like(entity, s, F.lit(0)))
        )

    return let(_nibbles(secret_key, kind, entity, F.lit(str(attempt))), made)


def _drawn(known: DataFrame, secret: str) -> DataFrame:
    """(kind, key, surrogate) for distinct (kind, key): surrogates differ from each other and from all keys.

    Each round draws for the keys that have none yet. Of those that drew the same, the least keeps it; a draw that is a key or was given
    before is void. Rounds go on until all have one; only numbers of a fixed width can run out, where their corpus fills the format.
    """
    open_, given, left, idle = known, None, known.count(), 0
    for attempt in count():
        drawn = written(open_.withColumn("surrogate", surrogate(F.col("key"), F.col("kind"), attempt, secret)), "pii-drawn")
        best = drawn.groupBy("surrogate").agg(F.min(F.struct("kind", "key")).alias("_b")).select("surrogate", "_b.*")
        best = best.join(known.select(F.col("key").alias("surrogate")), "surrogate", "left_anti")
        if given is not None:
            best = best.join(given.select("surrogate"), "surrogate", "left_anti")
        won = written(best.select("kind", "key", "surrogate"), "pii-won")
        given = won if given is None else given.unionByName(won)
        open_ = drawn.join(won, ["kind", "key"], "left_anti").select("kind", "key")
        before, left = left, open_.count()
        if not left:
            return given
        idle = idle + 1 if left == before else 0
        if idle == IDLE_ROUNDS:
            raise ValueError(f"{left} entities have no surrogate of their own: the corpus fills their formats")


def surrogates(entities: DataFrame, secret: str = KEY) -> DataFrame:
    """(entity, kind, surrogate) for the distinct entities. Spellings of one key get the surrogate of the key as they spell it.

    A name's given and family name have surrogates of their own, whatever title and names they stand with.
    """
    kinds = entities.select("entity").distinct().withColumn("kind", kind_of(F.col("entity")))
    known = written(kinds.withColumn("key", key_of(F.col("entity"), F.col("kind"))), "pii-entities")
    title, given, family, gender = _name_parts(F.col("entity"))
    plain, names = known.filter("kind <> 'name'"), known.filter("kind = 'name'").select("entity", "kind", title.alias("title"), given.alias("given"), family.alias("family"), gender.alias("gender"))
    keys = plain.select("kind", "key").unionByName(names.select(F.lit(FAMILY).alias("kind"), F.col("family").alias("key"))).unionByName(names.filter("given <> ''").select(F.col("gender").alias("kind"), F.col("given").alias("key")))
    drawn = _drawn(written(keys.distinct(), "pii-keys"), secret)
    plain = plain.join(drawn, ["kind", "key"]).select("entity", "kind", spelt(F.col("entity"), F.col("kind"), F.col("surrogate")).alias("surrogate"))
    families = drawn.filter(F.col("kind") == FAMILY).select(F.col("key").alias("family"), F.col("surrogate").alias("new_family"))
    givens = drawn.filter(F.col("kind").isin(GIVEN_F, GIVEN_M)).select(F.col("kind").alias("gender"), F.col("key").alias("given"), F.col("surrogate").alias("new_given"))
    names = names.join(families, "family").join(givens, ["gender", "given"], "left")
    return plain.unionByName(names.select("entity", "kind", F.concat_ws(" ", "title", "new_given", "new_family").alias("surrogate")))


def pseudonymise(docs: DataFrame, secret: str = KEY) -> DataFrame:
    """docs with each entity in text replaced, and n_entities (bigint) and entity_kinds (sorted, joined by commas).

    Texts without an entity don't change; a null text stays null with none. Rows that agree in doc_id and text are one document. The
    same corpus and secret give the same surrogates; another row may change one only where draws collide. Other columns stay as they are.
    """
    base = packed(docs, docs["text"].alias("text"))
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    # a document's entities by place; texts themselves are not moved for this
    places = base.select("_d", "_t", F.posexplode(found).alias("at", "entity")).dropDuplicates(["_d", "_t", "at"])
    places = written(places, "pii-places")
    named = places.join(surrogates(places, secret), "entity")
    per_doc = named.groupBy("_d", "_t").agg(F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias("_new"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("entity_kinds"))
    hit = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    # only texts with a hint go through the join
    rows = base.filter(hit).join(per_doc, ["_d", "_t"], "left")
    parts = F.split("text", ANY, -1)
    put = F.when(F.col("_new").isNull(), F.col("text")).otherwise(let(parts, lambda p: F.array_join(F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.get(F.col("_new"), i)["surrogate"], F.lit("")))), "")))
    plain = unpacked(base.filter(~hit), docs, more={"n_entities": F.lit(0).cast("long"), "entity_kinds": F.lit("")})
    return plain.unionByName(unpacked(rows, docs, {"text": put}, {"n_entities": F.greatest(F.coalesce(F.size("_new"), F.lit(0)), F.lit(0)).cast("long"), "entity_kinds": F.coalesce("entity_kinds", F.lit(""))}))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
