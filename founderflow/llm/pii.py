r"""Surrogates for personal data and secrets, with DataFrame and SQL functions only.

Entities are found by one pattern: e-mail addresses, keys and named secrets, IP addresses, card numbers (with an
issuer's leading digits and a valid check digit), phone numbers, social security numbers, IBANs, and names after a title or beginning with a known given
name. Each becomes a keyed, type-consistent replacement: digits for digits, lower and upper case letters for theirs,
separators in place; cards keep the first digit and a valid check digit, phones their country code, addresses their
top level domain, octets stay in range, keys their prefix; names keep gender, script and letter case. Keys and
named secrets are taken to their end, however long.

Coreference and distinctness. Replacements are drawn for canonical forms: letters and digits in lower case, so a
number written in two ways is one entity. Given and family names apart, so "Ms Rossi" and "Anna Rossi" agree; a
possessive 's is no part of a name; of several names the last is the family's; a person's gender is looked up over the whole corpus, so "Dr. Alex Foo" is drawn like
"Mr. Alex Foo" (names met with both genders are drawn as of neither). An address's domain is drawn apart, so addresses of
one domain stay so. Over the whole corpus all distinct canonical forms of a kind meet in one table; a candidate is
taken only if it is no real form of that kind and no other form took it. Losers draw again, later draws with more
characters of the same kind, until all have one: the map is one-to-one however few values a form's length admits. The key is the
caller's; without it replacements cannot be told.

Texts are rebuilt from the pieces between matches. Only texts with entities are joined to their replacements, by a
digest of the text, so copies share the work; the rest is a map over rows.

Defined results: null texts stay null, empty ones empty; texts without entities stay as they are, byte by byte;
repeated rows are each rewritten alike; entities of any length are matched and rewritten in linear time but for sorting; an empty table gives no rows; extra columns pass through, and if one is named
n_entities, the result's name gets an underscore at its end.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Titles by gender, and frequent given names by gender.
TITLES_M = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Signor", "Господин")
TITLES_F = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Signora", "Госпожа")
TITLES_U = ("Dr", "Prof")
GIVEN_M = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Daniel", "Peter", "Paul", "Hans", "Jürgen", "Klaus", "Pierre", "Jean", "Jacques", "Luis", "Carlos", "José", "Juan", "Pedro", "Иван", "Алексей", "Дмитрий", "Сергей")
GIVEN_F = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Emma", "Laura", "Ursula", "Monika", "Sabine", "Marie", "Sophie", "Camille", "María", "Carmen", "Lucía", "Sofía", "Elena", "Мария", "Анна", "Елена", "Ольга")
# Syllables from which replacement names are composed; fixed values.
LATIN = {"onset": ("Bal", "Cor", "Dar", "Fen", "Gal", "Hal", "Jor", "Kel", "Lor", "Mar", "Nor", "Per", "Ros", "Sil", "Tal", "Ver"), "middle": ("an", "en", "in", "on", "ar", "er", "ir", "or", "al", "el", "il", "ol", "am", "em", "im", "om"), "m": ("us", "ek", "ard", "win"), "f": ("a", "ina", "ette", "ia"), "u": ("is", "ay", "ey", "yn"), "family": ("son", "berg", "ford", "well")}
CYRILLIC = {"onset": ("Бел", "Вар", "Гор", "Дар", "Зим", "Кор", "Лад", "Мил", "Нор", "Пав", "Рад", "Сав", "Тим", "Фед", "Ход", "Чер"), "middle": ("ан", "ен", "ин", "он", "ар", "ер", "ир", "ор", "ал", "ел", "ил", "ол", "ам", "ем", "им", "ом"), "m": ("слав", "мир", "ий", "ей"), "f": ("а", "ина", "ия", "ана"), "u": ("о", "ко", "ли", "ри"), "family": ("енко", "евич", "ских", "дзе")}

_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# A name of two letters or more, up to a possessive 's. Nothing repeats an alternation: Java matches those by recursion.
_word = r"\p{Lu}(?=['’\-]?\p{L})(?!['’\-]s(?!\p{L}))\p{L}*+(?:['’\-](?!s(?!\p{L}))\p{L}++)*+"
_any = lambda *lists: "|".join(x for one in lists for x in one)
_next = rf" (?!(?:{_any(TITLES_M, TITLES_F, TITLES_U)})(?!\p{{L}})){_word}"  # the next title begins another name
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}+|\bsk-[A-Za-z0-9_\-]{20,}+",
    "secret": r"(?i:(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_\-]?key)\b)[ \t]{0,2}[=:][ \t]{0,2}[\"']?(?=[+/_.~=\-]*+[A-Za-z0-9])[A-Za-z0-9+/_.~=\-]{8,}+",
    "ip": rf"(?<![\d.])(?:{_octet}\.){{3}}{_octet}(?![\d.]*\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d\-])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])",
    "name": rf"(?=[A-ZÀ-ÞА-Я])(?<!\p{{L}})(?:(?:{_any(TITLES_M, TITLES_F, TITLES_U)})\.? {_word}(?:{_next}){{0,3}}|(?:{_any(GIVEN_M, GIVEN_F)})(?:{_next}){{1,4}})",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
SECRET = r"^([^=:]*[=:][ \t]{0,2}[\"']?)(.*)$"  # what a secret is named, and its value to the end
# Leading digits under which payment cards are issued; fixed values. A tenth of all other long numbers pass the check digit.
ISSUED = r"^(?:4|5[0-8]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[0-9]|6)"
STRICT = 8  # draws of the form's own length
QUERY_KEY = "surrogate-key-1"  # of the registered query and the pipeline, unless the session sets CONF
CONF = "spark.founderflow.pii.key"


def has_entity(t: Column) -> Column:
    """Whether the pattern matches, kind by kind, each behind a cheap test that its matches must pass."""
    hit = lambda kinds: t.rlike("|".join(f"(?:{KINDS[k]})" for k in kinds))
    any_of = lambda parts: reduce(lambda a, b: a | b, (t.contains(p) for p in parts))
    return (
        (t.contains("@") & hit(["email"]))
        | (t.rlike("[0-9]") & hit(["ip", "iban", "card", "ssn", "phone"]))
        | (any_of(["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-"]) & hit(["key"]))
        | (any_of(["=", ":"]) & hit(["secret"]))
        | hit(["name"])
    )


def kind_of(raw: Column) -> Column:
    out = None
    for kind, pattern in KINDS.items():
        hit = raw.rlike(f"^(?:{pattern})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("name")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Of digits with the check digit in place: 0 modulo 10 if valid."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _names(raw: Column) -> tuple[Column, Column]:
    """The words of a name without its title, and the gender that the title or the given name tells."""
    words = F.split(F.regexp_replace(raw, r"\.", ""), " ")
    names = F.when(words[0].isin(*TITLES_M, *TITLES_F, *TITLES_U), F.slice(words, 2, 4)).otherwise(words)
    gender = F.when(words[0].isin(*TITLES_M) | names[0].isin(*GIVEN_M), "m").when(words[0].isin(*TITLES_F) | names[0].isin(*GIVEN_F), "f").otherwise("u")
    return names, gender


def _atoms(raw: Column, kind: Column, gender: Column) -> Column:
    """The canonical forms within a raw entity, with the number of characters kept in front and at the end."""
    atom = lambda k, form, front, end: F.struct(k.alias("kind"), form.alias("form"), front.cast("int").alias("front"), end.cast("int").alias("end"))
    zero, plain = F.lit(0), F.regexp_replace(raw, r"[^\p{L}\p{N}]", "")
    value = F.regexp_extract(raw, SECRET, 2)
    prefix = F.regexp_replace(F.regexp_extract(raw, "^(?:AKIA|ASIA|gh[pousr]|sk-(?:(?:proj|svcacct|admin)-)?)", 0), "-", "")
    tld = F.length(F.regexp_extract(raw, r"\.([A-Za-z]+)$", 1))
    side = lambda k: F.lower(F.regexp_replace(F.substring_index(raw, "@", k), r"[^\p{L}\p{N}]", ""))
    country = F.when(raw.startswith("+"), F.length(F.regexp_extract(raw, r"^\+(\d+?)(?:[ .\-(]|\d{7,}$)", 1))).otherwise(0)
    names, _ = _names(raw)
    name = F.transform(names, lambda w, i: atom(F.when(i == F.size(names) - 1, F.lit("family")).otherwise(F.concat(F.lit("given_"), gender)), F.lower(w), zero, zero))
    return (
        F.when(kind == "name", name)
        .when(kind == "email", F.array(atom(kind, F.concat(side(1), F.lit("@"), side(-1)), zero, F.length(side(-1)) + 1), atom(F.lit("domain"), side(-1), zero, tld)))
        .when(kind == "key", F.array(atom(kind, plain, F.length(prefix), zero)))
        .when(kind == "secret", F.array(atom(kind, value, zero, zero)))
        .when(kind == "card", F.array(atom(kind, plain, F.lit(1), zero)))
        .when(kind == "iban", F.array(atom(kind, plain, F.lit(2), zero)))
        .when(kind == "phone", F.array(atom(kind, plain, country, zero)))
        .when(kind == "ip", F.array(atom(kind, raw, zero, zero)))
        .otherwise(F.array(atom(kind, plain, zero, zero)))
    )


def _nibbles(h: Column, i: Column, n: int, modulus: int) -> Column:
    return F.conv(F.substring(h, (i * n % 120 + 1).cast("int"), n), 16, 10).cast("int") % modulus


def draw(kind: Column, form: Column, front: Column, end: Column, attempt: int, h: Column, n: Column) -> Column:
    """A candidate of the form's kind, length and character classes; after STRICT attempts one character longer every second time.

    h, the form's keyed digest, and n, its length, are columns: each character looks them up."""
    more = max(0, (attempt - STRICT) // 2 + 1)

    def one(c: Column, i: Column) -> Column:
        digit = _nibbles(h, i, 3, 10).cast("string")
        leading = (_nibbles(h, i, 3, 8) + 2).cast("string")
        letter = F.char(F.lit(97) + _nibbles(h, i, 3, 26))
        return (
            F.when((i < front) | (i >= n - end), c)
            .when(c.rlike("[0-9]"), F.when(kind.isin("phone", "ssn") & (i == front), leading).otherwise(digit))
            .when(c.rlike("[a-z]"), F.when(c.rlike("[a-f]") & (kind == "secret"), F.substring(F.lit("abcdef"), (_nibbles(h, i, 3, 6) + 1).cast("int"), 1)).otherwise(letter))
            .when(c.rlike("[A-Z]"), F.upper(letter))
            .when(c.rlike(r"\p{L}"), letter)
            .otherwise(c)
        )

    plain = F.array_join(F.transform(F.split(form, ""), one), "")
    if more:
        longer = F.when(kind.isin("phone", "ssn", "card", "iban"), F.translate(F.substring(h, 1, more), "abcdef", "123456")).otherwise(F.translate(F.substring(h, 1, more), "0123456789", "ghijklmnop"))
        cut = n - end
        plain = F.concat(F.substring(plain, F.lit(1), cut), longer, F.substring(plain, cut + 1, end))
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    card = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0")))) % 10).cast("string"))
    octets = F.transform(F.split(form, r"\."), lambda o, i: F.when(F.lit(more > 0), 1 + _nibbles(h, i, 5, 254)).when(F.length(o) == 3, 100 + _nibbles(h, i, 4, 100)).when(F.length(o) == 2, 10 + _nibbles(h, i, 4, 90)).otherwise(1 + _nibbles(h, i, 4, 9)).cast("string"))

    def name(s: dict) -> Column:
        pick = lambda options, i: F.element_at(F.array(*map(F.lit, options)), _nibbles(h, F.lit(i), 3, len(options)) + 1)
        ends = F.when(kind == "family", pick(s["family"], 1)).when(kind == "given_m", pick(s["m"], 1)).when(kind == "given_f", pick(s["f"], 1)).otherwise(pick(s["u"], 1))
        return F.lower(F.concat(pick(s["onset"], 0), *[pick(s["middle"], 2 + i) for i in range((1 if attempt < 4 else 2) + attempt // 4)], ends))

    return F.when(kind == "card", card).when(kind == "ip", F.array_join(octets, ".")).when(kind.startswith("given_") | (kind == "family"), F.when(form.rlike(r"\p{IsCyrillic}"), name(CYRILLIC)).otherwise(name(LATIN))).otherwise(plain)


def surrogates(forms: DataFrame, key: str) -> DataFrame:
    """forms: distinct (kind, form, front, end). Adds sur, one-to-one within each kind and never a real form."""
    left, done = forms, None
    for attempt in count():
        digest = F.sha2(F.concat_ws("|", F.lit(key), "kind", F.lit(str(attempt)), "form"), 512)
        c = left.withColumns({"ff_h": digest, "ff_n": F.length("form")})
        c = c.withColumn("sur", draw(F.col("kind"), F.col("form"), F.col("front"), F.col("end"), attempt, F.col("ff_h"), F.col("ff_n"))).drop("ff_h", "ff_n")
        real = forms.select(F.col("kind"), F.col("form").alias("sur"))
        c = c.join(real, ["kind", "sur"], "left_anti")
        if done is not None:
            c = c.join(done.select("kind", "sur"), ["kind", "sur"], "left_anti")
        won = common.materialise(c.groupBy("kind", "sur").agg(F.min("form").alias("form")).select("kind", "form", "sur"))
        done = won if done is None else done.unionByName(won)
        left = common.materialise(left.join(won, ["kind", "form"], "left_anti"))
        if left.isEmpty():
            return done


def _filled(raw: Column, sur: Column) -> Column:
    """The letters and digits of sur in the places of those of raw, in their case; the rest of sur at the end."""
    at = F.transform(F.split(raw, ""), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    plain = lambda x: x["c"].rlike(r"[\p{L}\p{N}]")
    letters = F.filter(at, plain)

    def put(x: Column, got: Column) -> Column:
        got = F.coalesce(got, F.lit(""))
        return F.struct(x["i"].alias("i"), F.when(x["c"].rlike(r"\p{Lu}"), F.upper(got)).otherwise(got).alias("c"))

    filled = F.filter(F.zip_with(letters, F.split(sur, ""), put), lambda x: x["i"].isNotNull())
    placed = F.array_sort(F.concat(F.filter(at, lambda x: ~plain(x)), filled))
    return F.concat(F.array_join(F.transform(placed, lambda x: x["c"]), ""), F.substring(sur, F.size(letters) + 1, F.length(sur)))


def _filled_domain(raw: Column, sur: Column) -> Column:
    """A domain's replacement; where it is longer, the first label takes the additional characters."""
    more = F.length(sur) - F.length(F.regexp_replace(raw, r"[^\p{L}\p{N}]", ""))
    return F.when(more > 0, F.concat(F.substring(sur, F.lit(1), more), _filled(raw, F.substring(sur, more + 1, F.length(sur))))).otherwise(_filled(raw, sur))


def _titled(name: Column, raw: Column) -> Column:
    return F.when((F.upper(raw) == raw) & (F.length(raw) > 1), F.upper(name)).otherwise(F.initcap(name))


def replacements(raws: DataFrame, key: str) -> DataFrame:
    """raws: distinct raw entities. (raw, replacement) for each."""
    k = raws.withColumn("kind", kind_of(F.col("raw")))
    k = k.filter((F.col("kind") != "card") | (_digits(F.col("raw")).rlike(ISSUED) & (luhn_sum(_digits(F.col("raw"))) == 0)))
    names, told = _names(F.col("raw"))
    several = (F.col("kind") == "name") & (F.size(names) > 1)
    k = k.select("raw", "kind", F.when(several, F.lower(F.array_join(names, " "))).alias("person"), told.alias("told"))
    people = k.filter("person is not null and told <> 'u'").groupBy("person").agg(F.min("told").alias("low"), F.max("told").alias("high"))
    people = people.select("person", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("u").alias("gender"))
    k = k.join(people, "person", "left").withColumn("gender", F.coalesce("gender", F.lit("u")))
    k = common.materialise(k.select("raw", F.col("kind").alias("rk"), F.posexplode(_atoms(F.col("raw"), F.col("kind"), F.col("gender"))).alias("i", "a")).select("raw", "rk", "i", "a.*"))
    forms = common.materialise(k.groupBy("kind", "form").agg(F.min("front").alias("front"), F.min("end").alias("end")))
    both = k.join(surrogates(forms, key), ["kind", "form"]).groupBy("raw", "rk").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sur"))), lambda x: x["sur"]).alias("s"))
    words = F.split(F.col("raw"), " ")
    titled = F.regexp_replace(words[0], r"\.", "").isin(*TITLES_M, *TITLES_F, *TITLES_U)
    shift = F.when(titled, 1).otherwise(0)
    name = F.array_join(F.transform(words, lambda w, i: F.when(i < shift, w).otherwise(_titled(F.element_at("s", (i - shift + 1).cast("int")), w))), " ")
    head = F.regexp_extract("raw", SECRET, 1)
    sur = F.col("s")[0]
    address = F.concat(_filled(F.substring_index("raw", "@", 1), F.substring_index(sur, "@", 1)), F.lit("@"), _filled_domain(F.substring_index("raw", "@", -1), F.col("s")[1]))
    made = F.when(F.col("rk") == "name", name).when(F.col("rk") == "email", address).when(F.col("rk") == "secret", F.concat(head, sur)).when(F.col("rk") == "ip", sur).otherwise(_filled(F.col("raw"), sur))
    return common.materialise(both.select("raw", made.alias("replacement")))


def anonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with rewritten texts, and n_entities, the number of replaced entities."""
    name, of, news = (common.fresh(docs, c) for c in ("n_entities", "ff_d", "ff_s"))
    t = F.col(text)
    found = F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
    digest = F.sha2(t, 256)
    has = F.coalesce(has_entity(t), F.lit(False))
    hit = docs.filter(has)
    lists = common.materialise(hit.select(digest.alias(of), found.alias("ff_e")).groupBy(of).agg(F.first("ff_e").alias("ff_e")))
    each = lists.select(of, F.posexplode("ff_e").alias("i", "raw"))
    table = replacements(each.select("raw").distinct(), key)
    named = each.join(table, "raw", "left").groupBy(of).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("replacement", "raw").alias("new"), F.col("replacement").isNotNull().alias("done")))).alias(news))
    named = common.materialise(named)
    pieces = F.split(t, PATTERN, -1)
    joined = hit.join(named, digest == named[of])
    new = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(news, i)["new"], F.lit("")))), "")
    number = F.aggregate(news, F.lit(0).cast("long"), lambda a, x: a + x["done"].cast("long"))
    columns = lambda value: [value.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return docs.filter(~has).select(*columns(t), F.lit(0).cast("long").alias(name)).unionByName(joined.select(*[docs[c] if c != text else new.alias(c) for c in docs.columns], number.alias(name)))


def query_key(spark: SparkSession) -> str:
    return spark.conf.get(CONF, QUERY_KEY)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their entities replaced; n_chars is that of the new text."""
    out = anonymise(common.table(spark, sf_dir, "documents"), query_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long"))
