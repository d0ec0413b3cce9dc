"""Surrogates for personal data: keyed replacements of the same type, script, gender and format, the same for the same entity.

Entities are e-mail addresses, IPv4 addresses, phone, card and account numbers, IBANs, secrets and titled names. Each is
reduced to a canonical form (letter case, separators and titles do not count), so all its mentions in all documents get the
same surrogate, poured into the format of each mention. Surrogates are derived from a keyed digest: digits for digits, letters
of the same script and case, valid check digits where the original's were valid. Mail goes to the reserved domain example.com
(or .net, .org) and addresses to 10.0.0.0/8.

A name is a family name, with or without a given name before it. Family names have surrogates of their own, so that shorter and
longer mentions agree; given names have one for each person (gender, given and family name), of the title's gender. A title
that tells no gender takes that which the given name has elsewhere, if it has one only. In a document with a titled name, the
same name without a title, whole or the family name alone, is replaced too.

A table of all distinct entities is checked: two never share a surrogate (given names: within a family name), and a surrogate is
never another entity's real value; those that fail are drawn again until none is left. Who still fails after ``rounds`` draws has
too few free values of its form and gets a wider one: digits, letters, syllables or a second name more, one with each further
draw; for addresses, a first number beyond 255, which no host has.

Everything is DataFrame functions. Only mentions are exploded and joined; a mention that a third of all documents hold is
joined by AQE's split. Texts move once, to meet the replacements of their document.

Defined results: null texts stay null and empty texts empty; rows without entities are untouched; repeated rows are rewritten
alike; other columns are kept, but for one of the name of the count; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Workspace

#: Titles by gender.
FEMALE, MALE, NEUTRAL = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "г-жа"], ["Mr", "Herr", "Monsieur", "Señor", "г-н"], ["Dr", "Prof"]
#: Given names by gender and script, syllables of family names by script.
GIVEN = {
    ("f", "latin"): "Agnes Alma Anna Bella Carla Clara Dora Edith Elena Emma Flora Greta Hanna Helga Ida Irene Julia Karin Laura Lea Lena Lucia Maria Marta Nadia Nina Olga Paula Rita Rosa Ruth Sara Sofia Tina Vera Zita".split(),
    ("m", "latin"): "Adam Albert Anton Bruno Carl David Diego Emil Erik Felix Georg Hugo Ivan Jan Jonas Julius Karl Leo Leon Lukas Marco Martin Max Nils Oscar Otto Paul Peter Ralf Rene Simon Sven Theo Tom Viktor Walter".split(),
    ("n", "latin"): "Alex Charlie Chris Jamie Kim Lou Robin Sam Sascha Toni".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Ирина Лидия Мария Нина Ольга Раиса Софья Тамара".split(),
    ("m", "cyrillic"): "Антон Борис Вадим Глеб Денис Егор Захар Иван Игорь Лев Михаил Олег Павел Роман Степан Юрий".split(),
    ("n", "cyrillic"): "Валя Женя Саша Слава Тоня Шура".split(),
    ("f", "greek"): "Άννα Δήμητρα Ελένη Ζωή Ιωάννα Μαρία Νίκη Σοφία".split(),
    ("m", "greek"): "Αντώνης Γιάννης Δημήτρης Ηλίας Κώστας Μάρκος Νίκος Πέτρος".split(),
    ("n", "greek"): "Άλεξ Γκρέι Ντένι Χάρι".split(),
}
SYLLABLES = {"latin": "ba bel cor dan dor fen gar hal kel lin mar nor pel ros tal ven".split(), "cyrillic": "ба вел гор дан дор зен кар лен мар нор пел рос сал тал фен хол".split(), "greek": "βα γαλ δορ ζεν θελ καρ λεν μαρ νικ πελ ρος σαλ ταλ φεν χαλ ψαρ".split()}
SCRIPTS = [("cyrillic", r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхц"), ("greek", r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχ"), ("han", r"\p{IsHan}", "安百长东方高光海和江金林明南平青山水天文星云"), ("latin", r"[\p{L}&&[^A-Za-z]]", "áâäåçéèêëíîïñóôöúûü")]

#: Places by which a surrogate may be wider than its entity; far fewer hold any number of entities.
WIDEST = 40

#: As they are written, and in capitals but for one that is a word of its own.
_SHOUTED = [t.upper() for t in FEMALE + MALE + NEUTRAL if t != "Miss"]
_TITLES = "|".join(sorted(FEMALE + MALE + NEUTRAL + _SHOUTED, key=len, reverse=True))
_NAME = r"\p{Lu}(?:\p{Ll}{1,30}|\p{Lu}{1,30})(?:-\p{Lu}(?:\p{Ll}{1,30}|\p{Lu}{1,30})){0,3}(?!\p{L})"
#: What a text must hold for any of the patterns below to match; much cheaper to look for.
HINT = rf"\d|@|[a-fA-F]{{32}}|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_]|(?:{_TITLES})\.? \p{{Lu}}"
PATTERN = "|".join([
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,128}+(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][0-9A-Za-z_-]{16,200}+",
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,128}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}+",
    r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)",
    r"\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    r"(?<![\d-])\d{3}-\d{2,3}-\d{4}(?![\d-])",
    r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    rf"(?<!\p{{L}})(?:(?:{_TITLES})\.? ){{1,3}}{_NAME}(?: {_NAME})?",
])
TITLE = rf"^(?:(?:{_TITLES})\.? ){{1,3}}"


def mentions(text: Column) -> Column:
    """All mentions in a text, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def script_of(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def kind(m: Column) -> Column:
    digits = F.length(F.regexp_replace(m, r"\D", ""))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(TITLE), "person")
        .when(m.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip")
        .when(m.rlike(r"^[0-9a-fA-F]{32,}$") | m.rlike(r"^(?:sk|pk|ghp|gho|xoxb|xoxp)[-_]"), "secret")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.startswith("+") | m.startswith("(") | (digits < 13), "phone")
        .otherwise("card")
    )


def gender(m: Column) -> Column:
    of = lambda titles: m.rlike(rf"^(?:(?:{_TITLES})\.? )*(?:{'|'.join(t for x in titles for t in {x, x.upper()} - {'MISS'})})\.? ")
    return F.when(of(FEMALE), "f").when(of(MALE), "m").otherwise("n")


def canonical(m: Column, k: Column) -> Column:
    """The canonical form of a mention that isn't a person's."""
    return (
        F.when(k == "email", F.lower(m))
        .when(k == "secret", F.when(m.rlike(r"^[0-9a-fA-F]+$"), F.lower(m)).otherwise(m))
        .when(k == "iban", F.upper(F.regexp_replace(m, " ", "")))
        .when(k == "ip", m)
        .otherwise(F.regexp_replace(m, r"\D", ""))
    )


def _digest(key: str, *parts: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), *parts)
    return F.concat(F.sha2(text, 256), F.sha2(F.concat(text, F.lit("|more")), 256))


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substr(digest, F.pmod(i * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int")


def _letters(text: Column, digest: Column, hexadecimal: bool = False) -> Column:
    """Digits for digits, letters of the same script for letters; all else stays."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        pick = lambda of: F.substr(F.lit(of), F.pmod(b, F.lit(len(of))) + 1, F.lit(1))
        if hexadecimal:
            return pick("0123456789abcdef")
        out = F.when(c.rlike(r"\d"), pick("0123456789")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        for _, script, of in SCRIPTS:
            out = out.when(c.rlike(script), pick(of))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10."""
    n = F.length(digits)
    value = lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 1, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + (c.cast("int") >= 5).cast("int"))
    return F.pmod(F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda s, x: s + x), F.lit(10))


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a text of digits and capitals, a capital being two digits (A 10, Z 35)."""
    add = lambda r, c: F.pmod(F.when(c.rlike("[0-9]"), r * 10 + F.ascii(c) - 48).otherwise(r * 100 + F.ascii(c) - 55), F.lit(97))
    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c)))


def _iban(c: Column, rest: Column) -> Column:
    """Country and ``rest`` with check digits that are right if those of the IBAN ``c`` are, else wrong."""
    country = F.substr(c, F.lit(1), F.lit(2))
    right = _mod97(F.concat(F.substr(c, F.lit(5), F.length(c)), F.substr(c, F.lit(1), F.lit(4)))) == 1
    check = 98 - _mod97(F.concat(rest, country, F.lit("00")))
    return F.concat(country, F.lpad(F.when(right, check).otherwise(F.pmod(check - 1, F.lit(97)) + 2).cast("string"), 2, "0"), rest)


def surrogate(k: Column, c: Column, attempt: Column, key: str, extra: int = 0) -> Column:
    """The surrogate of a canonical form, itself canonical in form (digits, lower case), and wider by ``extra`` places."""
    d = _digest(key, k, c, attempt.cast("string"))
    more = lambda place: _letters(F.lit(place * extra), _digest(key, F.lit("wider"), d)) if extra else F.lit("")
    local, domain = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    end = F.regexp_extract(domain, r"\.(com|net|org)$", 1)
    hosts = F.regexp_extract(domain, r"^(?:.+(?=\.[^.]+\.[^.]+$)|[^.]+)", 0)
    email = F.concat(_letters(local, d), more("a"), F.lit("@"), _letters(hosts, _digest(key, F.lit("domain"), domain, attempt.cast("string"))), F.lit(".example."), F.when(end == "", "com").otherwise(end))
    ip = F.concat_ws(".", F.lit("10"), *(_byte(d, F.lit(i)).cast("string") for i in (1, 2, 3)))
    if extra:
        two = lambda i: _byte(d, F.lit(i)) * 256 + _byte(d, F.lit(i + 1))
        ip = F.concat_ws(".", (F.pmod(two(0), F.lit(744)) + 256).cast("string"), *(F.pmod(two(i), F.lit(1000)).cast("string") for i in (2, 4, 6)))
    digits = F.concat(more("0"), _letters(c, d))
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    valid = F.concat(body, F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    invalid = F.concat(body, F.pmod(11 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    card = F.when(_luhn(c) == 0, valid).otherwise(invalid)
    # the country's code stays, and the exchange 555, which no subscriber has
    phone = F.when(c.rlike(r"^1?\d{3}555\d{4}$"), F.concat(F.regexp_extract(c, r"^(1?)\d{10}$", 1), _letters(F.regexp_extract(c, r"^1?(\d{3})555", 1), d), F.lit("555"), _letters(F.substr(c, F.length(c) - 3, F.lit(4)), _digest(key, d)))).otherwise(F.concat(F.substr(c, F.lit(1), F.lit(1)), _letters(F.substr(c, F.lit(2), F.length(c)), d)))
    phone = F.concat(phone, more("0"))
    secret = F.when(c.rlike("^[0-9a-f]+$"), _letters(c, d, True)).otherwise(F.concat(F.regexp_extract(c, r"^[a-z]+[-_]", 0), _letters(F.regexp_replace(c, r"^[a-z]+[-_]", ""), d)))
    secret = F.concat(secret, more("0"))
    iban = _iban(c, F.concat(_letters(F.substr(c, F.lit(5), F.length(c)), d), more("0")))
    return F.when(k == "email", email).when(k == "ip", ip).when(k == "card", card).when(k == "phone", phone).when(k == "secret", secret).when(k == "iban", iban).when(k == "given", _given(c, d, extra)).otherwise(_family(c, d, extra))


def _pick(of: list[str], d: Column, i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, of)), F.pmod(_byte(d, i), F.lit(len(of))) + 1)


def _family(c: Column, d: Column, extra: int) -> Column:
    """As many names joined by hyphens as ``c`` has, of four syllables, the last of ``extra`` more."""
    parts = F.size(F.split(c, "-"))

    def of(script: str) -> Column:
        one = lambda n: F.concat_ws("", *(_pick(SYLLABLES[script], d, n * 4 + i) for i in range(4)))
        wider = F.concat(F.lit(""), *(_pick(SYLLABLES[script], d, F.lit(20 + i)) for i in range(extra)))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), parts - 1), one), "-"), wider)

    script = script_of(c)
    return F.when(script == "cyrillic", of("cyrillic")).when(script == "greek", of("greek")).otherwise(of("latin"))


def _given(c: Column, d: Column, extra: int) -> Column:
    """given:family for gender:given:family, as many given names joined by hyphens as there were, and ``extra`` more."""
    at = F.split(c, ":")
    sex, given, family = at[0], at[1], at[2]
    number = F.size(F.split(given, "-")) + extra

    def of(sign: str, script: str) -> Column:
        return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), number - 1), lambda n: _pick(GIVEN[sign, script], d, n)), "-"))

    by_sex = lambda script: F.when(sex == "f", of("f", script)).when(sex == "m", of("m", script)).otherwise(of("n", script))
    script = script_of(given)
    name = F.when(script == "cyrillic", by_sex("cyrillic")).when(script == "greek", by_sex("greek")).otherwise(by_sex("latin"))
    return F.concat(name, F.lit(":"), family)


def capital(name: Column) -> Column:
    """A name with a capital at its start and after hyphens."""
    return F.array_join(F.transform(F.split(name, "-"), lambda p: F.initcap(p)), "-")


def poured(m: Column, k: Column, s: Column) -> Column:
    """A surrogate in the format of a mention."""
    plain = F.regexp_replace(m, r"[^0-9A-Za-z]", "")
    places = F.split(m, "")
    # the n-th letter or digit of the mention becomes that of the surrogate, separators stay
    shown = F.array_join(F.transform(places, lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substr(s, F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), r"[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c)), "")
    # a wider surrogate has more of them than the mention, which ends with one
    shown = F.concat(shown, F.substr(s, F.length(plain) + 1, F.length(s)))
    upper = (m == F.upper(m)) & (plain != F.lower(plain))
    return F.when(k.isin("email", "secret"), F.when(upper, F.upper(s)).otherwise(s)).when(k == "ip", s).otherwise(shown)


def surrogate_table(entities: DataFrame, key: str, work: Workspace, rounds: int = 3) -> DataFrame:
    """(kind, canonical, surrogate) for distinct (kind, canonical), distinct and apart from all real values within a kind."""
    # drawing is much work for a row: a few rows must not share a task
    entities = entities.repartition(2 * entities.sparkSession.sparkContext.defaultParallelism, "kind", "canonical")
    drawn = work.write(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("canonical"), F.lit(0), key)), "drawn")
    for attempt in range(1, rounds + WIDEST + 1):
        # who has its surrogate from an earlier draw keeps it, so that the rest only shrinks
        twice = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canonical"))["canonical"].alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
        real = drawn.select("kind", F.col("canonical").alias("surrogate"))
        bad = drawn.join(twice, ["kind", "surrogate"]).where("canonical != keeper").select("kind", "canonical").union(drawn.join(real, ["kind", "surrogate"], "left_semi").select("kind", "canonical")).distinct()
        bad = work.write(bad.withColumn("bad", F.lit(1)), "bad")
        if bad.isEmpty():
            return drawn.select("kind", "canonical", "surrogate")
        again = surrogate(F.col("kind"), F.col("canonical"), F.lit(attempt), key, max(0, attempt - rounds))
        pick = lambda new, old: F.when(F.col("bad").isNotNull(), new).otherwise(F.col(old)).alias(old)  # noqa: E731, B023
        new = work.write(drawn.join(bad, ["kind", "canonical"], "left").select("kind", "canonical", pick(F.lit(attempt), "attempt"), pick(again, "surrogate")), "drawn")
        work.drop(drawn)
        drawn = new
    raise RuntimeError("entities without a surrogate of their own are left")


def people(each: DataFrame) -> DataFrame:
    """(__i, __t, m, family, person) of persons' mentions; ``person``: gender:given:family, null without a given name."""
    name = F.split(F.lower(F.regexp_replace("m", TITLE, "")), " ")
    rows = each.where("kind = 'person'").select("__i", "__t", "m", F.element_at(name, -1).alias("family"), F.when(F.size(name) > 1, name[0]).alias("given"), gender(F.col("m")).alias("sex"))
    told = rows.where("given is not null and sex != 'n'").groupBy("given").agg(F.min("sex").alias("told"), F.max("sex").alias("most")).where("told = most").drop("most")
    rows = rows.join(told, "given", "left")
    return rows.select("__i", "__t", "m", "family", F.when(F.col("given").isNotNull(), F.concat_ws(":", F.when(F.col("sex") == "n", F.coalesce("told", "sex")).otherwise(F.col("sex")), "given", "family")).alias("person"))


def replace(docs: DataFrame, key: str = "tessera", id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """The rows of ``docs`` with surrogates in the text, and the mentions replaced in ``count_col``, which replaces a column of that name."""
    work = Workspace(docs.sparkSession, "surrogates")
    text = F.col(text_col).cast("string")
    found = docs.select(F.col(id_col).alias("__i"), F.xxhash64(text).alias("__t"), F.array_distinct(F.when(text.rlike(HINT), mentions(text))).alias("all")).where(F.size("all") > 0)
    found = work.write(found.distinct(), "found")
    each = found.select("__i", "__t", F.explode("all").alias("m")).withColumn("kind", kind(F.col("m")))
    persons = work.write(people(each), "people")
    others = each.where("kind != 'person'").withColumn("canonical", canonical(F.col("m"), F.col("kind")))
    families, givens = persons.select(F.lit("family").alias("kind"), F.col("family").alias("canonical")), persons.where("person is not null").select(F.lit("given").alias("kind"), F.col("person").alias("canonical"))
    table = surrogate_table(work.write(others.select("kind", "canonical").union(families).union(givens).distinct(), "entities"), key, work)
    others = others.join(table, ["kind", "canonical"]).select("__i", "__t", "m", poured(F.col("m"), F.col("kind"), F.col("surrogate")).alias("new"))
    of = lambda kind, name, new: table.where(F.col("kind") == kind).select(F.col("canonical").alias(name), F.col("surrogate").alias(new))
    persons = persons.join(of("family", "family", "family_new"), "family").join(of("given", "person", "given_new"), "person", "left")
    whole = F.concat_ws(" ", capital(F.substring_index("given_new", ":", 1)), capital(F.col("family_new")))
    bare = F.regexp_replace("m", TITLE, "")
    as_written = F.when(bare == F.upper(bare), F.upper(whole)).otherwise(whole)
    persons = work.write(persons.select("__i", "__t", "m", F.concat(F.regexp_extract("m", TITLE, 0), as_written).alias("new"), capital(F.col("family")).alias("family"), capital(F.col("family_new")).alias("family_new"), F.when(F.col("person").isNotNull(), F.concat_ws(" ", capital(F.split("person", ":")[1]), capital(F.col("family")))).alias("whole"), whole.alias("whole_new")), "persons")
    maps = others.union(persons.select("__i", "__t", "m", "new")).groupBy("__i", "__t").agg(F.map_from_entries(F.collect_list(F.struct("m", "new"))).alias("__map"))
    # the names of a document's persons without their titles, also in capitals
    names = persons.select("__i", "__t", F.inline(F.array(*(F.struct(put(F.col(a)).alias("name"), put(F.col(b)).alias("new")) for put in (lambda c: c, F.upper) for a, b in (("whole", "whole_new"), ("family", "family_new"))))))
    names = names.where("name is not null").groupBy("__i", "__t", "name").agg(F.min("new").alias("new")).groupBy("__i", "__t").agg(F.map_from_entries(F.collect_list(F.struct("name", "new"))).alias("__names"))
    same = lambda a, b: a["__i"].eqNullSafe(b["__i"]) & (a["__t"] == b["__t"])
    maps = work.write(maps.join(names, same(maps, names), "left").select(maps["__i"], maps["__t"], "__map", "__names"), "maps")
    rows = docs.join(maps.hint("shuffle_hash"), docs[id_col].eqNullSafe(F.col("__i")) & (F.xxhash64(text) == F.col("__t")), "left")
    untitled = F.concat(F.lit(r"(?<![\p{L}\p{N}-])(?:"), F.array_join(F.reverse(F.array_sort(F.map_keys("__names"))), "|"), F.lit(r")(?![\p{L}\p{N}-])"))
    joined = lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))
    without = lambda a: F.when(F.col("__names").isNull(), a).otherwise(F.array_join(F.zip_with(F.split(a, untitled, -1), F.transform(F.regexp_extract_all(a, untitled, F.lit(0)), lambda w: F.element_at("__names", w)), joined), ""))
    pieces = F.zip_with(F.transform(F.split(text, PATTERN, -1), without), F.transform(mentions(text), lambda m: F.element_at("__map", m)), joined)
    new = F.when(F.col("__map").isNull(), text).otherwise(F.array_join(pieces, ""))
    count = F.when(F.col("__map").isNull(), F.lit(0)).otherwise(F.size(mentions(text)))
    columns = [new.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns if c != count_col]
    return rows.select(*columns, *([count.alias(count_col)] if count_col else []))
