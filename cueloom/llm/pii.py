"""Surrogates for personal data, by DataFrame functions only.

Entities found in texts (e-mail addresses, card numbers, phone numbers, IPv4 addresses, names after a
title) get keyed replacements of the same type and format: the same person's data gets the same
surrogate wherever it stands and however it is punctuated or capitalised, different data never the
same one, and no surrogate is an entity of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import stored

# Titles by gender and script, and given names to draw from.
TITLES = {
    ("latin", "m"): "Mr Herr Señor Sr Monsieur".split(),
    ("latin", "f"): "Mrs Ms Miss Frau Señora Sra Madame Mme Mlle".split(),
    ("latin", "n"): "Dr Prof".split(),
    ("cyrillic", "m"): "господин г-н Господин Г-н".split(),
    ("cyrillic", "f"): "госпожа г-жа Госпожа Г-жа".split(),
}
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Gustav Hugo Ivan Jonas Karl Leo Marco Noel Oscar Paul".split(),
    ("latin", "f"): "Alma Berta Clara Diana Elena Flora Greta Helena Irene Julia Karla Laura Maria Nora Olga Paula".split(),
    ("latin", "n"): "Alex Andrea Chris Dana Jamie Jody Kim Lee Noa Robin Sam Sasha Taylor Toni Val Yael".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Ольга".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со та те то".split(),
}
#: At most so many syllables are added: 36**24 forms, and a host label of at most 63 characters.
MORE = 24

_NAME = r"\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)",
    "card": r"(?<![\d-])(?:\d{4}[ -]?){3}\d{4}(?![\d-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w])",
    "name": rf"(?<![\p{{L}}-])(?:{'|'.join(t for names in TITLES.values() for t in names)})\.? {_NAME}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())

_DIGIT, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def kind_of(entity: Column) -> Column:
    out = F.when(entity.contains("@"), "email").when(entity.rlike(rf"^{PATTERNS['ip']}$"), "ip").when(entity.rlike(rf"^{PATTERNS['card']}$"), "card")
    return out.when(entity.rlike(r"^\p{L}"), "name").otherwise("phone")


def normal_form(kind: Column, entity: Column) -> Column:
    """What makes two spellings the same entity: letter case and the punctuation of numbers don't count."""
    digits = F.regexp_replace(entity, r"\D", "")
    return F.when(kind.isin("card", "phone"), digits).when(kind == "ip", entity).otherwise(F.lower(F.regexp_replace(entity, r"\.(?= )", "")))


def _number(*parts: Column) -> Column:
    """A keyed non-negative number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 15), 16, 10).cast("long")


def _stream(text: Column, seed: Column) -> Column:
    """Each letter and digit of a text (its characters as an array) moved by a keyed step; the rest stays."""

    def move(c: Column, i: Column) -> Column:
        step = _number(seed, i.cast("string"))
        at = lambda alphabet: F.substr(F.lit(alphabet), (F.pmod(F.position(c, F.lit(alphabet)) - 1 + step, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("[0-9]"), at(_DIGIT)).when(c.rlike("[a-z]"), at(_LOWER)).when(c.rlike("[A-Z]"), at(_UPPER)).otherwise(c)

    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), move)


def _joined(chars: Column) -> Column:
    return F.array_join(chars, "")


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's rule over a string of 16 digits."""
    value = lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), value), F.lit(0), lambda a, x: a + x)


def _pick(options: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(number, F.lit(len(options))) + 1).cast("int"))


def _syllables(script: str, seed: Column, count: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda k: _pick(SYLLABLES[script], _number(seed, k.cast("string")))), "")


def surrogate_form(kind: Column, normal: Column, key: Column, attempt: Column) -> Column:
    """Surrogate of a normal form, itself a normal form; another for every attempt.

    Later attempts draw from larger spaces: e-mails get a host label more, names another given name
    or a longer surname, all of syllables whose number grows with the attempt up to MORE. Numbers
    and addresses keep their length, so their spaces are what their formats hold.
    """
    more = F.least(attempt, F.lit(MORE))
    seed = F.concat_ws("\0", key, kind, normal, attempt.cast("string"))
    local, domain = F.substring_index(normal, "@", 1), F.substring_index(normal, "@", -1)
    host = F.regexp_replace(domain, r"\.?[^.]+\.[^.]+$", "")
    label = F.when(attempt > 0, F.concat(_syllables("latin", F.concat_ws("\0", key, F.lit("label"), domain, attempt.cast("string")), F.greatest(more, F.lit(1))), F.lit("."))).otherwise("")
    email = F.concat(_joined(_stream(local, seed)), F.lit("@"), label, F.when(host != "", F.concat(_joined(_stream(host, F.concat_ws("\0", key, F.lit("host"), domain))), F.lit("."))).otherwise(""), F.lit("example."), _pick(["com", "net", "org"], _number(key, F.lit("domain"), domain)))
    moved = _joined(_stream(normal, seed))
    body = F.concat(F.substring(normal, 1, 1), F.substring(moved, 2, 14))
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.concat(body, F.when(_luhn(normal) % 10 == 0, check).otherwise(F.substring(moved, 16, 1)))
    phone = F.concat(F.substring(normal, 1, 1), F.substring(moved, 2, 20))
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.pmod(_number(seed, k.cast("string")), F.lit(254)) + 1).cast("string")), ".")
    title, words = F.substring_index(normal, " ", 1), F.split(normal, " ")
    last = F.element_at(words, -1)
    name = F.lit(None).cast("string")
    for (script, gender), titles in TITLES.items():
        low = [t.lower() for t in titles]
        surname_seed = F.concat_ws("\0", key, F.lit("surname"), last, F.when(F.size(words) > 2, F.lit("")).otherwise(F.when(attempt > 0, attempt.cast("string")).otherwise("")))
        surname = _syllables(script, surname_seed, F.when(F.size(words) > 2, F.lit(4)).otherwise(F.lit(4) + more))
        given = _pick([g.lower() for g in GIVEN[script, gender]], _number(seed, F.lit("given")))
        second = F.when(attempt > 1, _syllables(script, F.concat_ws("\0", seed, F.lit("more")), F.greatest(more, F.lit(1)))).otherwise(_pick([g.lower() for g in GIVEN[script, gender]], _number(seed, F.lit("more"))))
        extra = F.when(attempt > 0, F.concat(F.lit("-"), second)).otherwise("")
        name = F.when(title.isin(low), F.concat_ws(" ", title, F.when(F.size(words) > 2, F.concat(given, extra)), surname)).otherwise(name)
    return F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip).when(kind == "name", name).otherwise(phone)


def in_format(kind: Column, entity: Column, form: Column) -> Column:
    """A surrogate written the way the entity was: punctuation of numbers, capitals of letters."""
    chars = F.filter(F.split(entity, ""), lambda c: c != "")
    digits_before = lambda i: F.length(F.regexp_replace(F.substr(entity, F.lit(1), i + 1), r"\D", ""))
    number = _joined(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(form, digits_before(i), F.lit(1))).otherwise(c)))
    capital = lambda text: F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))
    local = _joined(F.transform(F.filter(F.split(form, ""), lambda c: c != ""), lambda c, i: F.when(F.substr(entity, i + 1, F.lit(1)).rlike("[A-Z]") & (i < F.instr(form, "@") - 1), F.upper(c)).otherwise(c)))
    parts = F.transform(F.slice(F.split(form, " "), 2, 3), lambda w: F.array_join(F.transform(F.split(w, "-"), capital), "-"))
    name = F.concat_ws(" ", F.substring_index(entity, " ", 1), F.array_join(parts, " "))
    return F.when(kind == "email", local).when(kind == "name", name).when(kind == "ip", form).otherwise(number)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, normal, form) for the distinct `entities(kind, normal)`, one-to-one.

    Each attempt draws for all that are still open; a drawn form is taken if no entity of the texts
    and no other taken form equals it, the smallest of equal draws first. Ends when none is open:
    the spaces of e-mails and names grow with the attempt; only numbers and addresses, which keep
    their length, can be more than their format has surrogates for, which is an error.
    """
    known = stored(entities.select("kind", "normal").distinct())
    open_, taken, attempt = known, None, 0
    while not open_.isEmpty():
        drawn = open_.withColumn("form", surrogate_form(F.col("kind"), F.col("normal"), F.lit(key), F.lit(attempt)))
        drawn = drawn.join(known.withColumnRenamed("normal", "form"), ["kind", "form"], "left_anti")
        if taken is not None:
            drawn = drawn.join(taken.select("kind", "form"), ["kind", "form"], "left_anti")
        fresh = drawn.groupBy("kind", "form").agg(F.min("normal").alias("normal")).select("kind", "normal", "form")
        taken = stored(fresh if taken is None else taken.unionByName(fresh))
        open_ = stored(known.join(taken.select("kind", "normal"), ["kind", "normal"], "left_anti"))
        attempt += 1
        if attempt > 64 and not open_.filter(~F.col("kind").isin("email", "name")).isEmpty():
            raise ValueError("more distinct numbers or addresses of a format than surrogates")
    return taken if taken is not None else known.withColumn("form", F.col("normal"))


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """Per row of `docs(doc_id, text)`: doc_id, text with surrogates, n_entities and
    `entities ARRAY<STRUCT<kind, entity, surrogate>>` in order of place.

    A null text stays null, an empty one empty. Rows with null or repeated ids are kept; equal rows
    get equal results; other columns are left out. Only rows with entities are shuffled, joined by
    entity: a very frequent entity is a skewed join that adaptive execution splits.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    has = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    found = stored(rows.filter(has).withColumn("found", F.regexp_extract_all("text", F.lit(f"({PATTERN})"), F.lit(0))).withColumn("row", F.xxhash64("doc_id", "text")))
    each = found.select("row", "found").distinct().select("row", F.posexplode("found").alias("place", "entity"))
    each = each.withColumn("kind", kind_of(F.col("entity"))).withColumn("normal", normal_form(F.col("kind"), F.col("entity")))
    taken = surrogates(each, key)
    named = each.join(taken, ["kind", "normal"]).select("row", F.struct("place", "kind", "entity", in_format(F.col("kind"), F.col("entity"), F.col("form")).alias("surrogate")).alias("e"))
    lists = named.groupBy("row").agg(F.array_sort(F.collect_list("e")).alias("e"))
    gaps = F.split("text", PATTERN, -1)
    pieces = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("e", i)["surrogate"], F.lit(""))))
    done = found.join(lists, "row").select("doc_id", F.array_join(pieces, "").alias("text"), F.size("e").cast("long").alias("n_entities"), F.transform("e", lambda x: F.struct(x["kind"].alias("kind"), x["entity"].alias("entity"), x["surrogate"].alias("surrogate"))).alias("entities"))
    rest = rows.filter(~has).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<struct<kind:string,entity:string,surrogate:string>>").alias("entities"))
    return done.unionByName(rest)
