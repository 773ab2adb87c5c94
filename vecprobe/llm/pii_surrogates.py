"""PII surrogates (operator 3); DataFrame functions only.

E-mail addresses, IPv4 addresses, phone numbers, card and account numbers,
hexadecimal secrets and titled or known personal names are found by one
pattern. Each is replaced by a surrogate computed from a keyed hash of its
normal form: the same entity gets the same surrogate in every document, the
format stays (separators, case, check digit of card numbers, country code),
names keep title, gender and script.

Collision check: the distinct entities of all documents are compared with one
another's surrogates and with the entities themselves; all but the smallest of
those that collide move on to their next attempt until none collides. Names are
checked and moved word by word, so a word has one surrogate in every mention of
it. Later attempts give longer surrogates (name words at once, others from the
second), so no number of entities uses them up. Only moved entities are joined
back; all other surrogates need no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .columns import set_aside

# Titles by the gender they tell, and given names that mark a name without title.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа"]
OTHER_TITLES = ["Dr", "Prof", "Доктор"]
MALE_NAMES = ["John", "James", "Robert", "Michael", "David", "Peter", "Paul", "Thomas", "Hans", "Karl", "Pierre", "Jean", "Carlos", "José", "Juan", "Иван", "Пётр", "Сергей"]
FEMALE_NAMES = ["Mary", "Anna", "Maria", "Susan", "Linda", "Emma", "Julia", "Laura", "Sophie", "Claire", "Carmen", "Lucía", "Ana", "Мария", "Ольга", "Елена"]

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_WORD = r"\p{Lu}[\p{L}'’-]*+"
_ANY = lambda xs: "(?:" + "|".join(xs) + ")"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
IP = rf"(?<![\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\p{{N}}|\.\p{{N}})"
PHONE = (r"(?<![\p{N}+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
         r"|(?<![0-9-])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}])"
NUMBER = r"(?<![\p{N}.,])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])|(?<![\p{L}\p{N}.,])[0-9]{13,19}(?!\p{N})"
NAME = (rf"(?<![\p{{L}}\p{{N}}]){_ANY(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)}\.? {_WORD}(?: {_WORD})?"
        rf"|(?<![\p{{L}}\p{{N}}]){_ANY(MALE_NAMES + FEMALE_NAMES)} {_WORD}")
#: Secrets and long numbers come before phones, so that none is found in part.
PATTERN = "|".join([EMAIL, IP, SECRET, NUMBER, PHONE, NAME])
#: Texts without a match of this cheap pattern have no entity.
HINT = r"@|[0-9]{3}|[0-9]\.[0-9]|\+[0-9]|[0-9a-f]{32}|[0-9A-F]{32}|" + _ANY(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES + MALE_NAMES + FEMALE_NAMES) + r"\b"
#: Country calling codes, none of which begins another.
CALLING_CODE = "(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_SYLLABLES = {"latin": ["ba", "do", "fe", "ga", "ki", "lo", "ma", "ne", "pi", "ra", "so", "ta", "ve", "vi", "zo", "lu"],
              "cyrillic": ["ба", "до", "фе", "га", "ки", "ло", "ма", "не", "пи", "ра", "со", "та", "ве", "ви", "зо", "лу"]}


def let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.transform(F.array(x), f)[0]


def kind(e: Column) -> Column:
    return (F.when(F.contains(e, F.lit("@")), "email")
            .when(e.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), "ip")
            .when(e.rlike(r"^[0-9A-Fa-f]{32,128}$"), "secret")
            .when(e.rlike(r"^\p{L}"), "name")
            .when(e.rlike(r"^[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]"), "number").otherwise("phone"))


def normal(e: Column) -> Column:
    """The form that mentions of one entity share: lower case, or the digits
    (after a plus if the number names its country)."""
    return F.when(kind(e).isin("number", "phone"), F.regexp_replace(e, "[^0-9+]", "")).otherwise(F.lower(e))


def _keyed(secret: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", secret, *parts).cast("binary"), 256)


def _byte(h: Column, i: Column) -> Column:
    """The i-th byte of a hex digest, counting round."""
    return F.conv(F.substr(h, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(e: Column) -> Column:
    return F.split(e, "(?!^)")


def _join(parts: Column) -> Column:
    return F.array_join(parts, "")


def _like(e: Column, digest: Column) -> Column:
    """Letters and digits replaced one by one, of the same script and case."""
    def swap(c: Column, n: Column) -> Column:
        letter = lambda alphabet: F.substr(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))
        new = (F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
               .when(c.rlike(r"\p{IsCyrillic}"), letter("абвгдежзиклмнопрстуфхцчш"))
               .when(c.rlike(r"\p{IsGreek}"), letter("αβγδεζηθικλμνξοπρστυφχψω"))
               .when(c.rlike(r"\p{L}"), letter("abcdefghijklmnopqrstuvwxyz")).otherwise(c))
        return let(new, lambda x: F.when(c.rlike(r"\p{Lu}"), F.upper(x)).otherwise(x))

    return let(digest, lambda h: _join(F.transform(_chars(e), lambda c, i: let(_byte(h, i), lambda n: swap(c, n)))))


def _check_digit(payload: Column) -> Column:
    def add(acc: Column, i: Column, n: Column) -> Column:
        d = F.substr(payload, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 0, 2).otherwise(1)
        return let(d, lambda x: acc + x - F.when(x > 9, 9).otherwise(0))

    total = let(F.char_length(payload), lambda n: F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: add(acc, i, n)))
    return F.pmod(-total, F.lit(10)).cast("string")


def _into_format(e: Column, digits: Column) -> Column:
    """``e`` with its digits replaced in order, as far as it has any."""
    def put(c: Column, i: Column) -> Column:
        nth = F.char_length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substr(digits, nth, F.lit(1))).otherwise(c)

    return _join(F.transform(_chars(e), put))


def _longer(attempt: Column) -> Column:
    """Characters by which a surrogate outgrows its entity."""
    return F.floor(attempt.cast("int") / 2).cast("int")


def _email(e: Column, secret: Column, attempt: Column) -> Column:
    local, domain = F.concat(F.substring_index(e, "@", 1), F.repeat(F.lit("a"), _longer(attempt))), F.substring_index(e, "@", -1)
    host, top = F.regexp_extract(domain, r"^(.*)\.", 1), F.substring_index(domain, ".", -1)
    return F.concat(_like(local, _keyed(secret, F.lit("local"), F.lower(e), attempt)), F.lit("@"),
                    _like(host, _keyed(secret, F.lit("host"), F.lower(domain))), F.lit("."), top)


def _ip(e: Column, secret: Column, attempt: Column) -> Column:
    octets = lambda h: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_byte(h, i), F.lit(254)) + 1).cast("string"))
    return F.array_join(let(_keyed(secret, F.lit("ip"), e, attempt), octets), ".")


def _secret(e: Column, secret: Column, attempt: Column) -> Column:
    parts = [_keyed(secret, F.lit(f"secret{i}"), F.lower(e), attempt) for i in range(2)]
    new = F.substr(F.concat(*parts), F.lit(1), F.char_length(e))
    return F.when(e == F.upper(e), F.upper(new)).otherwise(new)


def _digits(e: Column, secret: Column, attempt: Column) -> Column:
    """The new digits follow from the normal form alone, whatever the spelling."""
    payload = lambda d: F.substr(d, F.lit(1), F.char_length(d) - 1)

    def made(n: Column) -> Column:
        stream = F.translate(_keyed(secret, F.lit("digits"), n, attempt), "abcdef", "283917")
        keep = F.regexp_extract(n, rf"^\+({CALLING_CODE})", 1)
        return let(F.regexp_replace(n, rf"^\+{CALLING_CODE}", ""), lambda old: F.concat(keep, replaced(old, stream)))

    def replaced(old: Column, stream: Column) -> Column:
        card = (F.char_length(old) >= 13) & (let(payload(old), _check_digit) == F.substr(old, F.char_length(old), F.lit(1)))
        checked = lambda d: F.when(card, let(payload(d), lambda x: F.concat(x, _check_digit(x)))).otherwise(d)
        return let(F.substr(stream, F.lit(1), F.char_length(old) + _longer(attempt)), checked)

    def put(n: Column, new: Column) -> Column:
        size = F.char_length(F.regexp_replace(n, r"\+", ""))
        return F.concat(_into_format(e, new), F.substr(new, size + 1, F.char_length(new)))

    return let(F.regexp_replace(e, "[^0-9+]", ""), lambda n: let(made(n), lambda new: put(n, new)))


def _name_word(w: Column, sex: Column, secret: Column, attempt: Column) -> Column:
    """The surrogate of one word of a name: a given name ("m", "f") or any other ("x")."""
    ends = {"latin": ("n", "na", "ler"), "cyrillic": ("н", "на", "лин")}

    def made(h: Column, script: str) -> Column:
        table = F.array(*[F.lit(x) for x in _SYLLABLES[script]])
        size = F.pmod(_byte(h, F.lit(31)), F.lit(4)) + 4 + attempt.cast("int")
        parts = F.transform(F.sequence(F.lit(1), size), lambda k: F.element_at(table, F.pmod(_byte(h, k - 1), F.lit(16)) + 1))
        end = F.when(sex == "m", ends[script][0]).when(sex == "f", ends[script][1]).otherwise(ends[script][2])
        return F.initcap(F.concat(_join(parts), end))

    make = lambda h: F.when(w.rlike(r"\p{IsCyrillic}"), made(h, "cyrillic")).otherwise(made(h, "latin"))
    new = let(_keyed(secret, F.lit("name"), F.lower(w), sex, attempt), make)
    return let(new, lambda n: F.when((F.char_length(w) > 1) & (w == F.upper(w)), F.upper(n)).otherwise(n))


def _name_words(e: Column, title, word) -> Column:
    """The words of a name: ``title`` of a title, ``word`` of another and its sex."""
    def of(first: Column) -> Column:
        titled = first.isin(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
        gender = F.when(first.isin(MALE_TITLES + MALE_NAMES), "m").when(first.isin(FEMALE_TITLES + FEMALE_NAMES), "f").otherwise("x")
        last = F.size(F.split(e, " ")) - 1
        each = lambda w, i: F.when((i == 0) & titled, title(w)).otherwise(let(F.when(i == last, "x").otherwise(gender), lambda g: word(w, g)))
        return F.transform(F.split(e, " "), each)

    return let(F.regexp_replace(F.substring_index(e, " ", 1), r"\.$", ""), of)


def _name_key(w: Column, sex: Column) -> Column:
    return F.concat_ws(" ", sex, F.lower(w))


def entity_parts(e: Column) -> Column:
    """(kind, normal, e) of what is checked on its own: the words of a name, or ``e``."""
    part = lambda k, n, x: F.struct(k.alias("kind"), n.alias("normal"), x.alias("e"))
    none = F.lit(None).cast("struct<kind:string,normal:string,e:string>")
    words = F.filter(_name_words(e, lambda w: none, lambda w, g: part(F.lit("name"), _name_key(w, g), w)), lambda x: x.isNotNull())
    return let(kind(e), lambda k: F.when(k == "name", words).otherwise(F.array(part(k, normal(e), e))))


def _unnamed(k: Column, e: Column, secret: Column, a: Column) -> Column:
    return (F.when(k == "email", _email(e, secret, a)).when(k == "ip", _ip(e, secret, a)).when(k == "secret", _secret(e, secret, a))
            .otherwise(_digits(e, secret, a)))


def part_surrogate(kind: Column, normal: Column, e: Column, secret: Column, attempt: Column) -> Column:
    """The surrogate of one of the ``entity_parts``."""
    return let(attempt.cast("string"), lambda a: F.when(kind == "name", _name_word(e, F.substring(normal, 1, 1), secret, a))
               .otherwise(_unnamed(kind, e, secret, a)))


def surrogate(e: Column, secret: Column, attempt) -> Column:
    """``attempt`` gives that of a part's kind and normal form."""
    def of(k: Column) -> Column:
        word = lambda w, g: let(attempt(F.lit("name"), _name_key(w, g)).cast("string"), lambda a: _name_word(w, g, secret, a))
        return (F.when(k == "name", F.array_join(_name_words(e, lambda w: w, word), " "))
                .otherwise(let(attempt(k, normal(e)).cast("string"), lambda a: _unnamed(k, e, secret, a))))

    return let(kind(e), of)


def find_entities(docs: DataFrame) -> DataFrame:
    """Adds ``_found``: the entities of ``text`` in order (null text: none)."""
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    return docs.withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))


def moved_entities(found: DataFrame, key: str) -> DataFrame | None:
    """(kind, normal, attempt) of the ``entity_parts`` that cannot take their
    first surrogate; None if there are none."""
    e = found.select(F.explode("_found").alias("e")).select(F.inline(entity_parts(F.col("e"))))
    e = cut_lineage(e.groupBy("kind", "normal").agg(F.min("e").alias("e")), "entities")
    at = e.withColumn("attempt", F.lit(0))
    real = e.select("kind", F.when(F.col("kind") == "name", F.lower("e")).otherwise(F.col("normal")).alias("new"), F.lit(True).alias("real")).distinct()
    while True:
        at = cut_lineage(at.withColumn("s", part_surrogate(F.col("kind"), F.col("normal"), F.col("e"), F.lit(key), F.col("attempt"))), "surrogates")
        new = at.withColumn("new", F.when(F.col("kind") == "name", F.lower("s")).otherwise(normal(F.col("s"))))
        first = new.groupBy("kind", "new").agg(F.min("normal").alias("first"))
        clash = cut_lineage(new.join(first, ["kind", "new"]).join(real, ["kind", "new"], "left")
                            .filter("real or normal <> first").select("kind", "normal", F.lit(1).alias("move")), "clashes")
        if clash.isEmpty():
            break
        at = (at.join(clash, ["kind", "normal"], "left")
              .select("kind", "normal", "e", (F.col("attempt") + F.coalesce("move", F.lit(0))).alias("attempt")))
    moved = at.filter("attempt > 0").select("kind", "normal", "attempt")
    return None if moved.isEmpty() else moved


def replace_pii(docs: DataFrame, key: str, count_as: str | None = None) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced by surrogates; with
    ``count_as`` a column of how many.

    A null text stays null and an empty one empty; texts without entities stay
    as they are. A text of any length is searched whole, in one task; where two
    patterns match at a place, the first listed wins. All other columns, whatever
    their names, and repeated rows are kept (one named as ``count_as`` is
    replaced); an empty table gives no rows. Another ``key`` gives other
    surrogates."""
    docs, back = set_aside(docs, "_found", "_moved", "_text")
    found = find_entities(docs)
    moved = moved_entities(found.select("_found"), key)
    attempt = lambda kind, normal: F.lit(0)
    if moved is not None:
        mine = (found.filter(F.size("_found") > 0).select(F.sha2("text", 256).alias("_text"), F.explode(F.array_distinct("_found")).alias("e"))
                .select("_text", F.inline(entity_parts(F.col("e")))).select("_text", "kind", "normal").distinct().join(moved, ["kind", "normal"])
                .groupBy("_text").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "normal"), "attempt"))).alias("_moved")))
        found = (found.withColumn("_text", F.when(F.size("_found") > 0, F.sha2("text", 256)))
                 .join(mine, "_text", "left").drop("_text"))
        attempt = lambda kind, normal: F.coalesce(F.try_element_at(F.col("_moved"), F.concat_ws("|", kind, normal)), F.lit(0))
    new = F.transform("_found", lambda e: surrogate(e, F.lit(key), attempt))
    pieces = F.split("text", PATTERN, -1)
    mixed = F.zip_with(pieces, new, lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
    out = found.withColumn("text", F.when(F.size("_found") > 0, F.array_join(mixed, "")).otherwise(F.col("text")))
    if count_as:
        out = out.withColumn(count_as, F.size("_found"))
    return back(out.drop("_found", "_moved"))
