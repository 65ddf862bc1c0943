"""Operator 3: surrogates for personal data (native: DataFrame functions only).

Detected: e-mail addresses, secrets (long hexadecimal strings), IBANs, card numbers,
social security numbers, phone numbers, IPv4 addresses, and persons named after a form of
address.  Each mention gets a surrogate of its own type: derived by SHA-256 from a
secret key, the type and the canonical value, and dressed like the mention
(separators, letter case, digits per octet, card check digit, the form of address with its
gender, the script of the name).  Equal canonical values get equal surrogates
in the whole corpus (coreference); surnames are mapped alone, so "Mr Smith" and
"Mr John Smith" agree, and so is each given name under a form of address of its
gender (male, female, either): distinct names stay distinct as a whole.

Distinctness is checked over all entities of the corpus: where two values would
get one surrogate, or a surrogate equals a real value, the entity takes the next
attempt until none is left.  Names get longer with the attempt, so the space
grows with the corpus.  The first attempt is computed inside the
projection; if an entity needs a later one, the documents that hold such entities are
joined to the texts, which moves all texts once.

Edge cases: null text stays null, empty text empty; rows that repeat get
the same result; texts of any length are rewritten whole; overlapping
candidates are read left to right, the first pattern in the list wins; ties
between colliding entities go to the smaller canonical value; an empty table gives
no rows; `replace_entities` keeps all other columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.llm.common import materialise, positional, restored, table

KEY_CONF, DEFAULT_KEY = "spark.clausewise.surrogate.key", "set spark.clausewise.surrogate.key in production"
MAX_ATTEMPTS, WIDE = 64, 3

MALE = "Mr|Herr|Señor|Sr|Monsieur|господин|г-н|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Mademoiselle|госпожа|г-жа|Κυρία"
NEUTRAL = "Dr|Prof|Mx"
NAME = r"\p{Lu}[\p{L}'’-]+"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?:{FEMALE}|{MALE}|{NEUTRAL})\.? {NAME}(?: {NAME}){{0,2}}"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "person": PERSON,
}
ANY = "|".join(PATTERNS.values())
#: A text without any of these cannot hold an entity.
HINT = rf"[@0-9]|[A-Fa-f]{{32}}|(?:{FEMALE}|{MALE}|{NEUTRAL})\.? \p{{Lu}}"

# Names by script: 16 given names per gender and 16 syllables, picked by hex digits; later attempts add syllables.
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Greta Irene Julia Laura Maria Nora Olga Paula Rita Sara Teresa Vera Zoe".split(),
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Leon Marco Nico Oscar Paul Simon Viktor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лариса Мария Нина Ольга Полина Раиса София".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
    ("greek", "f"): "Άννα Βάσω Δάφνη Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κλειώ Λυδία Μαρία Νίκη Όλγα Ράνια Σοφία Χαρά".split(),
    ("greek", "m"): "Άρης Βασίλης Γιώργος Δήμος Ερμής Ηλίας Θωμάς Ιάσων Κώστας Λεωνίδας Μάρκος Νίκος Πέτρος Σταύρος Φίλιππος Χάρης".split(),
}
SYLLABLES = {
    "latin": "ba do fe gi ka lo me ni pa ro su ta ve wi ra no".split(),
    "cyrillic": "ба до ве ги ка ло ме ни па ро су та фе зи ра но".split(),
    "greek": "βα δο φε γι κα λο με νι πα ρο σου τα θε ζι ρα νο".split(),
}


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _titled(mention: Column) -> tuple[Column, Column, Column]:
    """Words of a person's mention; whether the form of address is female, male."""
    words = F.split(mention, " ")
    bare = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
    return words, bare.rlike(f"^(?:{FEMALE})$"), bare.rlike(f"^(?:{MALE})$")


def _given_kind(female: Column, male: Column) -> Column:
    return F.when(female, F.lit("given_f")).when(male, F.lit("given_m")).otherwise(F.lit("given_n"))


def _given_words(words: Column) -> Column:
    """Those between the form of address and the surname."""
    return F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))


def named_in(mention: Column) -> Column:
    """(kind, canon) of all entities of a mention: itself and, of a person, the given names."""
    kind = kind_of(mention)
    words, female, male = _titled(mention)
    given = F.transform(_given_words(words), lambda w: F.struct(_given_kind(female, male).alias("kind"), F.lower(w).alias("canon")))
    whole = F.array(F.struct(kind.alias("kind"), canonical(mention, kind).alias("canon")))
    return F.when(kind == "person", F.concat(whole, given)).otherwise(whole)


def pool(kind: Column) -> Column:
    """Kinds whose surrogates must differ from each other."""
    return F.when(kind.startswith("given_"), F.lit("given")).otherwise(kind)


def kind_of(mention: Column) -> Column:
    """Type of a mention: the first pattern that matches the whole of it."""
    out = F.lit("person")
    for name in reversed([n for n in PATTERNS if n != "person"]):
        out = F.when(mention.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def canonical(mention: Column, kind: Column) -> Column:
    """What makes two mentions the same entity."""
    return (F.when(kind.isin("card", "ssn"), digits_of(mention))
            .when(kind == "phone", F.concat(F.when(mention.startswith("+"), F.lit("+")).otherwise(F.lit("")), digits_of(mention)))
            .when(kind == "iban", F.regexp_replace(mention, " ", ""))
            .when(kind == "person", F.lower(F.element_at(F.split(mention, " "), -1)))
            .otherwise(F.lower(mention)))


def _hex(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _pick(values: list[str], hex_digit: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.conv(hex_digit, 16, 10).cast("int") + 1))


def script_of(name: Column) -> Column:
    return (F.when(name.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(name.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin")))


def decimals(more: Column) -> Column:
    return F.translate(more, "abcdef", "035792")


def _by_script(script: Column, build) -> Column:
    return F.when(script == "cyrillic", build("cyrillic")).when(script == "greek", build("greek")).otherwise(build("latin"))


def luhn_digit(body: Column) -> Column:
    """Check digit that completes the digits `body`."""
    n = F.length(body)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + _luhn_term(F.substring(body, i, F.lit(1)).cast("int"), n - i))
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _luhn_term(digit: Column, from_right: Column) -> Column:
    double = digit * 2
    return F.when(F.pmod(from_right, F.lit(2)) == 0, F.when(double > 9, double - 9).otherwise(double)).otherwise(digit)


def stream(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """128 keyed hexadecimal digits of an entity and attempt."""
    return F.concat(_hex(key, kind, canon, attempt.cast("string")), _hex(key, kind, canon, attempt.cast("string"), F.lit("more")))


def surrogate(kind: Column, canon: Column, more: Column, decimal: Column, attempt: Column) -> Column:
    """Canonical surrogate of an entity: same type, script and length (an
    address whose short octets leave too few values gets any octets from
    attempt WIDE on).  more: its keyed stream; decimal: the same as decimal digits."""
    digest = more
    n = F.length(canon)

    def digits(count: Column) -> Column:
        return F.substring(decimal, F.lit(1), count)

    body = F.concat(F.substring(canon, 1, 1), F.substring(decimal, F.lit(1), n - 2))
    is_luhn = luhn_digit(F.substring(canon, F.lit(1), n - 1)) == F.substring(canon, -1, 1)
    card = F.concat(body, F.when(is_luhn, luhn_digit(body)).otherwise(F.substring(decimal, F.lit(40), F.lit(1))))
    ssn = F.concat(F.translate(F.substring(digest, 1, 1), "0123456789abcdef", "1234512345123451"), F.substring(decimal, 2, 8))
    country = F.regexp_extract(canon, r"^\+(1|7|[2-9][0-9])", 1)  # one- and two-digit codes are kept as they are
    phone = F.when(canon.startswith("+"), F.concat(F.lit("+"), country, digits(n - 1 - F.length(country)))).otherwise(digits(n))
    octets = F.split(canon, r"\.")
    ip = F.concat_ws(".", *[_octet(F.element_at(octets, i + 1), F.substring(digest, 1 + 8 * i, 7), attempt >= WIDE) for i in range(4)])
    iban = F.concat(F.substring(canon, 1, 2), F.array_join(F.transform(F.sequence(F.lit(3), n), lambda i: F.when(
        F.substring(canon, i, F.lit(1)).rlike("[0-9]"), F.substring(decimal, i, F.lit(1))).otherwise(
        F.translate(F.substring(more, i, F.lit(1)), "0123456789abcdef", "ABCDEFGHKLMNPRST"))), ""))
    secret = F.substring(more, F.lit(1), n)
    local = F.concat(_by_script(F.lit("latin"), lambda s: F.concat(*[_pick(SYLLABLES[s], F.substring(digest, i, 1)) for i in range(1, 5)])),
                     F.lit("."), F.substring(decimal, 9, 6))
    email = F.concat(local, F.lit("@mail"), F.substring(decimal, 20, 1), F.lit(".example.org"))
    return (F.when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "phone", phone).when(kind == "ip", ip)
            .when(kind == "iban", iban).when(kind == "secret", secret).when(kind == "email", email)
            .when(kind.startswith("given_"), _given(kind, canon, digest, attempt)).otherwise(_family(canon, digest, attempt)))


def _octet(octet: Column, hex7: Column, wide: Column) -> Column:
    """An octet with as many digits."""
    r = F.conv(hex7, 16, 10).cast("long")
    return (F.when(wide, r % 254 + 1).when(F.length(octet) == 1, r % 9 + 1).when(F.length(octet) == 2, r % 90 + 10).otherwise(r % 155 + 100)).cast("string")


def _family(canon: Column, digest: Column, attempt: Column) -> Column:
    """Five syllables, one more with each attempt."""
    return _by_script(script_of(canon), lambda s: F.concat(
        *[_pick(SYLLABLES[s], F.substring(digest, i, 1)) for i in range(1, 6)], _syllables(s, digest, 6, F.least(attempt, F.lit(50)))))


def _given(kind: Column, canon: Column, digest: Column, attempt: Column) -> Column:
    """A given name, with two more syllables with each attempt (lower case)."""
    pick = F.substring(digest, 1, 1)
    female = (kind == "given_f") | (kind == "given_n") & (F.substring(digest, 2, 1) < F.lit("8"))
    return F.lower(_by_script(script_of(canon), lambda s: F.concat(
        F.when(female, _pick(GIVEN[(s, "f")], pick)).otherwise(_pick(GIVEN[(s, "m")], pick)), _syllables(s, digest, 3, F.least(attempt * 2, F.lit(50))))))


def _syllables(script: str, digest: Column, first: int, n: Column) -> Column:
    """n syllables by the hexadecimal digits from `first` on."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _pick(
        SYLLABLES[script], F.substring(digest, i + (first - 1), F.lit(1)))), "")).otherwise(F.lit(""))


def _attempt(attempts: Column | None, kind: Column, canon: Column) -> Column:
    return F.lit(0) if attempts is None else F.coalesce(attempts[F.concat_ws("|", kind, canon)], F.lit(0))


def dressed(mention: Column, kind: Column, value: Column, attempts: Column | None, key: str) -> Column:
    """The surrogate in the form of the mention."""
    flat = F.when(kind == "phone", digits_of(value)).otherwise(value)
    # digit groups: the i-th digit (IBAN: letter or digit) of the mention becomes the i-th of the surrogate
    kept = F.when(kind == "iban", F.lit("[^A-Z0-9]")).otherwise(F.lit("[^0-9]"))
    grouped = F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), lambda i: F.when(
        F.regexp_replace(F.substring(mention, i, F.lit(1)), kept, F.lit("")) == "", F.substring(mention, i, F.lit(1))).otherwise(
        F.substring(flat, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), kept, F.lit(""))), F.lit(1)))), "")
    upper = (mention == F.upper(mention)) & (mention != F.lower(mention))
    cased = F.when(upper, F.upper(value)).otherwise(value)
    return (F.when(kind.isin("card", "ssn", "phone", "iban"), grouped).when(kind.isin("secret", "email"), cased)
            .when(kind == "ip", value).otherwise(_person(mention, value, attempts, key)))


def _person(mention: Column, family: Column, attempts: Column | None, key: str) -> Column:
    words, female, male = _titled(mention)
    title = F.element_at(words, 1)
    kind = _given_kind(female, male)

    def given(word: Column) -> Column:
        canon = F.lower(word)
        attempt = _attempt(attempts, kind, canon)
        return F.initcap(_given(kind, canon, _hex(key, kind, canon, attempt.cast("string")), attempt))

    inner = F.transform(_given_words(words), given)
    last = F.element_at(words, -1)
    name = F.initcap(family)
    name = F.when(script_of(last) == "cyrillic", F.concat(name, F.when(female, F.lit("ва")).otherwise(F.lit("в")))).otherwise(name)
    name = F.when((last == F.upper(last)) & (F.length(last) > 1), F.upper(name)).otherwise(name)
    return F.concat_ws(" ", F.concat(F.array(title), inner, F.array(name)))


def _mentions(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (kind, canon) of all texts."""
    found = docs.select(F.explode(_mentions(F.col(text_col))).alias("m")).groupBy("m").agg(F.lit(1).alias("_"))
    return found.select(F.explode(named_in(F.col("m"))).alias("e")).select("e.kind", "e.canon").distinct()


def assign(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate is not theirs
    alone: after collision checks no two entities share a surrogate and none is a real value."""
    real = materialise(found, "pii-entities")

    def valued(df: DataFrame) -> DataFrame:
        more = df.withColumn("_more", stream(F.col("kind"), F.col("canon"), F.col("attempt"), key)).withColumn("_decimal", decimals(F.col("_more")))
        return more.withColumn("value", surrogate(F.col("kind"), F.col("canon"), F.col("_more"), F.col("_decimal"), F.col("attempt"))).drop("_more", "_decimal")

    named = valued(real.withColumn("attempt", F.lit(0)).withColumn("since", F.lit(0)))
    for round_no in range(MAX_ATTEMPTS):
        named = materialise(named, "pii-named")
        # who has it from an earlier round keeps a shared surrogate, else the smallest canonical value
        keeps = named.groupBy(pool(F.col("kind")).alias("pool"), "value").agg(
            F.min(F.struct("since", "canon", "kind")).alias("keeper"), F.count("*").alias("n"))
        taken = real.select(pool(F.col("kind")).alias("pool"), F.col("canon").alias("value"), F.lit(True).alias("is_real")).distinct()
        shared = keeps.join(taken, ["pool", "value"], "left").filter("n > 1 OR is_real")
        moved = (named.withColumn("pool", pool(F.col("kind"))).join(shared, ["pool", "value"])
                 .filter("is_real OR canon <> keeper.canon OR kind <> keeper.kind").select("kind", "canon"))
        moved = materialise(moved, "pii-moved")
        if moved.isEmpty():
            return named.filter("attempt > 0").select("kind", "canon", "attempt")
        again = valued(named.join(moved, ["kind", "canon"]).drop("value").withColumn("attempt", F.col("attempt") + 1).withColumn("since", F.lit(round_no + 1)))
        named = named.join(moved, ["kind", "canon"], "left_anti").unionByName(again)
    raise ValueError(f"entities still collide after {MAX_ATTEMPTS} attempts: the surrogate space of a type is too small")


def _rewritten(text: Column, attempts: Column | None, key: str) -> Column:
    """The text with every mention replaced; attempts: map of 'kind|canon' to attempt."""

    # step by step, so that each value is computed once per mention
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    found = F.transform(found, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), canonical(x["m"], x["kind"]).alias("canon")))

    def streamed(x: Column) -> Column:
        attempt = _attempt(attempts, x["kind"], x["canon"])
        return F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["canon"].alias("canon"),
                        stream(x["kind"], x["canon"], attempt, key).alias("more"), attempt.alias("attempt"))

    found = F.transform(found, streamed)
    found = F.transform(found, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), surrogate(
        x["kind"], x["canon"], x["more"], decimals(x["more"]), x["attempt"]).alias("value")))
    new = F.transform(found, lambda x: dressed(x["m"], x["kind"], x["value"], attempts, key))
    between = F.split(text, ANY, -1)
    woven = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get(new, i), F.lit("")))), "")
    return F.when(text.rlike(HINT), woven).otherwise(text)


def replace_entities(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", key: str | None = None) -> DataFrame:
    """`docs` with surrogates in the text column; its columns and rows stay."""
    key = key or docs.sparkSession.conf.get(KEY_CONF, DEFAULT_KEY)
    names = docs.columns
    docs, id_col, text_col = positional(docs, id_col, text_col)
    later = materialise(assign(entities(docs, text_col), key), "pii-later")
    text = F.col(text_col)
    if later.isEmpty():
        return restored(docs.withColumn(text_col, _rewritten(text, None, key)), names)
    # documents with such an entity, their attempts as a map
    each = docs.filter(text.rlike(HINT)).select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), F.explode(F.array_distinct(_mentions(text))).alias("m"))
    each = each.select("_id", "_h", F.explode(named_in(F.col("m"))).alias("e")).select("_id", "_h", "e.kind", "e.canon").join(later, ["kind", "canon"])
    maps = each.select("_id", "_h", F.concat_ws("|", "kind", "canon").alias("k"), "attempt").distinct().groupBy("_id", "_h").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias("_attempts"))
    maps = materialise(maps, "pii-maps")
    joined = docs.withColumn("_h0", F.xxhash64(text)).alias("d").join(maps.alias("m"), F.expr(f"d.`{id_col}` <=> m._id AND d._h0 = m._h"), "left")
    return restored(joined.withColumn(text_col, F.when(F.col("_attempts").isNull(), _rewritten(text, None, key)).otherwise(
        _rewritten(text, F.col("_attempts"), key))), names)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.size(_mentions(F.col("text"))), F.lit(0)).alias("n_replaced"))
    return replace_entities(docs)
