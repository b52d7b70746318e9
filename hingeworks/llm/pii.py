"""Personal data replaced by surrogates, with DataFrame functions only.

Detected entities (mail and network addresses, phone, card, account and social-security numbers, keys and passwords,
names after a title or a common given name) are replaced by values of the same type and format. An entity consists of
parts: a mail address of its local part and its domain, a name of its given name and its surname, anything else of one.
Each part is replaced by a value derived from a keyed digest of its normal form, so equal parts get equal surrogates in
any text and spelling (coreference), and a surname that a text introduces is replaced where it stands alone there, too.
A collision check over all distinct parts gives each of them a surrogate of its own that is no part of the input, so that
different entities stay different.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hingeworks.llm.common import cut, cuts_so_far, drop_cuts_since, ranked, unused

#: The setting that holds the key. Without it an application draws a random one, so that nobody can compute the surrogates.
KEY_SETTING = "spark.hingeworks.pii.key"
_drawn: dict[str, str] = {}
#: From this attempt on surrogates of parts without a fixed length grow by a sign an attempt, so that small pools suffice.
GROWS = 4
#: Rounds of the collision check at most; what is left then (formats of fixed length that are full) is numbered.
ROUNDS = 12

_TITLE_M = r"Mr|Mister|Sir|Herr|Señor|Sr|Don|Monsieur|Господин|г-н|Κύριος"
_TITLE_F = r"Mrs|Ms|Miss|Madam|Frau|Señora|Señorita|Sra|Srta|Doña|Madame|Mme|Mlle|Mademoiselle|Госпожа|г-жа|Κυρία"
_TITLE_U = r"Dr|Prof|Professor|Doctor|Doctora|Docteur"
#: Given names that mark a name without a title.
_GIVEN_M = r"James|John|Robert|Michael|William|David|Thomas|Charles|Peter|Paul|George|Daniel|Mark|Andrew|Kevin|Brian|Edward|Richard|Joseph|Hans|Klaus|Jürgen|Stefan|Wolfgang|Pierre|Jean|Michel|Luis|José|Carlos|Juan|Miguel|Antonio|Иван|Сергей|Пётр|Дмитрий|Алексей"
_GIVEN_F = r"Mary|Anna|Maria|María|Elizabeth|Sarah|Susan|Karen|Emma|Julia|Laura|Helen|Alice|Alicia|Linda|Patricia|Jennifer|Barbara|Nancy|Emily|Ursula|Monika|Petra|Claudia|Claire|Sophie|Camille|Carmen|Lucía|Isabel|Ольга|Мария|Ирина|Елена|Татьяна"
_PARTICLES = r"von|van|de|der|den|del|della|di|da|du|la|le|bin|ten|ter|zu"
_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:['’-]?\p{Lu}\p{Ll}+)*+"
_LAST = rf"(?:(?:{_PARTICLES}) ){{0,3}}{_NAME}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: What stands before a password or key, up to its first sign.
_LABEL = r"(?i:password|passwd|pwd|token|secret|api[ _-]?key)\s{0,3}[=:]\s{0,3}[\x22']?"
#: Types and their patterns, the first that fits wins; so do a card's usual groupings before digits with any blanks. \p classes are Java's.
PATTERNS = {
    "email": r"(?<![\p{L}\p{Nd}._%+-])[\p{L}\p{Nd}._%+-]{1,64}+@[\p{L}\p{Nd}-]{1,63}(?:\.[\p{L}\p{Nd}-]{1,63}){1,6}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])",
    "secret": rf"(?=[PpTtSsAa]){_LABEL}[^\s\x22',;]{{6,}}+",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ip6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d+(-])(?:\d{13,19}(?![\d-])|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3}(?![\d/-]|[.,]\d))?(?![\d-])|\d{4}[ -]\d{6}[ -]\d{4,5}(?![\d-])|\d(?:[ -]?\d){12,18}(?![\d-]))",
    "phone": r"(?:(?<![\d+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+[01]\d{0,2}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|(?<![\d+])\+[2-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}|(?<![\d.,/-])0\d{2,4}[ /-]\d{6,8}(?![\d.,/-]\d|\d))(?!\d)",
    "name": rf"(?=[\p{{Lu}}г])(?<![\p{{L}}])(?:(?:{_TITLE_M}|{_TITLE_F}|{_TITLE_U})\.? {_LAST}(?: {_LAST})?|(?:{_GIVEN_M}|{_GIVEN_F}) {_LAST})(?![\p{{L}}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text with any entity must contain, by kind of sign; most texts are passed over by these cheap scans.
DIGIT, LABEL = "[0-9@]", rf"(?=[PpTtSsAa]){_LABEL}"
CALLED = rf"(?=[\p{{Lu}}г])(?<![\p{{L}}])(?:{_TITLE_M}|{_TITLE_F}|{_TITLE_U}|{_GIVEN_M}|{_GIVEN_F})\b"
#: Kinds whose surrogates may be longer than what they replace.
FREE = ("mail", "host", "key", "secret", "given-m", "given-f", "surname")

#: What a surrogate replaces.
LETTER = r"[\p{L}\p{Nd}]"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYR_L, _CYR_U = "абвгдежзиклмнопрстуфхцчш", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШ"
_GRK_L, _GRK_U = "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
#: Consonants, vowels, endings by gender and for surnames, by script.
_SOUNDS = {
    "latin": ("bdfghjklmnprstvz", "aeiou", {"m": ["n", "r", "s", "k", "rt", "l"], "f": ["a", "ia", "ina", "elle"], "s": ["er", "man", "sen", "ley", "ot", "ez"]}),
    "cyrillic": ("бвгджзклмнпрст", "аеиоу", {"m": ["н", "р", "с", "к", "й", "л"], "f": ["а", "ия", "ина", "ла"], "s": ["ов", "ин", "ский", "енко", "ев", "ич"]}),
    "greek": ("βγδζθκλμνπρστφ", "αειου", {"m": ["ος", "ης", "ας", "ων", "ις", "ιος"], "f": ["α", "η", "ια", "ινα"], "s": ["ιδης", "ακης", "οπουλος", "ατος", "ου", "ιας"]}),
}


def key_of(spark: SparkSession) -> str:
    """The configured key, or one drawn at random for this application: surrogates then agree within it alone."""
    return spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def hinted(text: Column) -> Column:
    """Whether the text can hold an entity at all."""
    labelled = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(LABEL)
    return text.rlike(DIGIT) | labelled | text.rlike(CALLED)


def matches(text: Column) -> Column:
    """All matches in order, as an array; empty without any, also for null."""
    found = F.call_function("regexp_extract_all", text, F.lit(ANY), F.lit(0))
    return F.when(hinted(text), found).otherwise(F.array().cast("array<string>"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def kind_of(value: Column) -> Column:
    """The type of a match, or null for what only looks like one: a bare digit run is a card only if its check digit is right."""
    tests = {k: "^(?:" + p + ")$" for k, p in PATTERNS.items()}
    found = reduce(lambda other, k: F.when(value.rlike(tests[k]), k).otherwise(other), reversed(list(tests)), F.lit(None).cast("string"))
    bare = value.rlike("^[0-9]+$")
    return let(found, lambda kind: F.when((kind == "card") & bare & (_luhn_sum(value) % 10 != 0), None).otherwise(kind))


def normal(kind: Column, value: Column) -> Column:
    """What makes two spellings the same part: numbers by their letters and digits (a phone's leading +1 aside), names and addresses in lower case."""
    bare = F.upper(F.regexp_replace(value, r"[^\p{L}\p{Nd}]", ""))
    national = F.when(value.rlike(r"^\+1(?:\D*\d){10}$"), F.substring(bare, F.lit(2), F.length(bare))).otherwise(bare)
    lower = kind.isin("mail", "host", "ip6", "given-m", "given-f", "surname")
    return F.when(kind == "phone", national).when(kind.isin("card", "ssn", "iban"), bare).when(lower, F.lower(value)).otherwise(value)


def secret_of(value: Column) -> Column:
    """A match's part behind its label."""
    return F.regexp_replace(value, "^" + _LABEL, "")


def title_of(words: Column) -> Column:
    """The words' title, or an empty text."""
    return F.when(words[0].rlike(rf"^(?:{_TITLE_M}|{_TITLE_F}|{_TITLE_U})\.?$"), words[0]).otherwise("")


def named(words: Column) -> Column:
    """The words of a name, each (kind, value); titles and particles have no kind."""
    capital = r"^\p{Lu}"

    def of(title: Column) -> Column:
        first = F.when(title == "", 0).otherwise(1)
        given = F.exists(F.slice(words, first + 2, F.size(words)), lambda w: w.rlike(capital)) & F.get(words, first).rlike(capital)
        gender = (
            F.when(words[0].rlike(rf"^(?:{_TITLE_M}|{_GIVEN_M})\.?$"), "given-m")
            .when(words[0].rlike(rf"^(?:{_TITLE_F}|{_GIVEN_F})\.?$"), "given-f")
            .when(F.get(words, first).rlike("[aаяαη]$"), "given-f")
            .otherwise("given-m")
        )
        kind = lambda w, i: F.when((i < first) | ~w.rlike(capital), None).when((i == first) & given, gender).otherwise("surname")
        return F.transform(words, lambda w, i: F.struct(kind(w, i).alias("kind"), w.alias("value")))

    return let(title_of(words), of)


def parts_of(kind: Column, value: Column) -> Column:
    """The parts of an entity, each (kind, value); what is not replaced has no kind."""
    part = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    mail = F.array(part(F.lit("mail"), F.substring_index(value, "@", 1)), part(F.lit("host"), F.substring_index(value, "@", -1)))
    name = let(F.split(value, " "), named)
    behind = secret_of(value)
    secret = F.array(part(F.lit(None).cast("string"), F.substring(value, F.lit(1), F.length(value) - F.length(behind))), part(F.lit("secret"), behind))
    return F.when(kind == "email", mail).when(kind == "name", name).when(kind == "secret", secret).otherwise(F.array(part(kind, value)))


def _digest(*parts: Column) -> Column:
    """128 bytes as hex, keyed on both sides of the message."""
    inner = F.sha2(F.concat_ws("\u0001", *parts), 256)
    return let(inner, lambda d: F.concat(*[F.sha2(F.concat(parts[0], F.lit(f"\u0001{i}\u0001"), d), 256) for i in range(4)]))


def _byte(digest: Column, i: Column | int) -> Column:
    at = (i if isinstance(i, Column) else F.lit(i)) % 128 * 2 + 1
    return F.conv(F.substring(digest, at, F.lit(2)), 16, 10).cast("int")


def _pick(pool: str, b: Column) -> Column:
    return F.substring(F.lit(pool), b % len(pool) + 1, F.lit(1))


def _same_shape(kind: Column, value: Column, digest: Column) -> Column:
    """Each letter or digit replaced by one of its case and script; the k-th of them takes the k-th byte of the digest.

    Values of digits and small hexadecimal letters stay so.
    Letters of other scripts are replaced by Latin ones, and so is every sign of a value without letters or digits.
    """
    hexes = value.rlike(r"^[0-9a-f]*[0-9][0-9a-f]*$") & value.rlike("[a-f]")

    def new(c: Column, k: Column, b: Column, hexed: Column) -> Column:
        within = lambda a, z: (c >= F.lit(a)) & (c <= F.lit(z))
        return (
            F.when(hexed, _pick("0123456789abcdef", b))
            .when(within("0", "9"), F.when(k == 0, b % 8 + 2).otherwise(b % 10).cast("string"))
            .when(within("a", "z"), _pick(_LOWER, b))
            .when(within("A", "Z"), _pick(_UPPER, b))
            .when(within("а", "я"), _pick(_CYR_L, b))
            .when(within("А", "Я"), _pick(_CYR_U, b))
            .when(within("α", "ω"), _pick(_GRK_L, b))
            .when(within("Α", "Ω"), _pick(_GRK_U, b))
            .otherwise(_pick(_LOWER, b))
        )

    part = F.when(value.rlike(LETTER), LETTER).otherwise("(?s).")

    def filled(hexed: Column) -> Column:
        fresh = F.transform(F.call_function("regexp_extract_all", value, part, F.lit(0)), lambda c, k: let(_byte(digest, k), lambda b: new(c, k, b, hexed)))
        return F.array_join(F.zip_with(F.split(value, part, -1), fresh, lambda rest, c: F.concat(rest, F.coalesce(c, F.lit("")))), "")

    return let(hexes, filled)


def _luhn_sum(digits: Column) -> Column:
    """Sum of the digits, from the right every second one doubled; the last digit counts once."""
    back = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    each = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _check_digit(number: Column) -> Column:
    """What appended to the digits of number makes them pass the Luhn test."""
    return ((F.lit(10) - _luhn_sum(F.concat(digits_of(number), F.lit("0"))) % 10) % 10).cast("string")


def _mod97(code: Column) -> Column:
    """Remainder of an account number's letters and digits by 97, its first four moved behind, letters from 10 on."""
    bare = F.regexp_replace(code, "[^A-Z0-9]", "")
    moved = F.split(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4)), "")
    value = lambda c: F.locate(c, "0123456789" + _UPPER) - 1 if isinstance(c, str) else F.call_function("locate", c, F.lit("0123456789" + _UPPER)) - 1
    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), lambda r, c: let(value(c), lambda v: (F.when(v > 9, r * 100).otherwise(r * 10) + v) % 97))


def _valid_iban(code: Column) -> Column:
    """The account number with the check digits (its third and fourth sign) that make it valid."""
    zero = F.concat(F.substring(code, 1, 2), F.lit("00"), F.substring(code, F.lit(5), F.length(code)))
    return F.concat(F.substring(code, 1, 2), F.lpad((F.lit(98) - _mod97(zero)).cast("string"), 2, "0"), F.substring(code, F.lit(5), F.length(code)))


def _from(pool: Column, b: Column) -> Column:
    return F.substring(pool, b % F.length(pool) + 1, F.lit(1))


def _extra(attempt: Column) -> Column:
    """Signs that a late attempt adds."""
    return F.least(F.greatest(attempt - (GROWS - 1), F.lit(0)), F.lit(ROUNDS)).cast("int")


def _added(digest: Column, attempt: Column) -> Column:
    return F.array_join(F.transform(F.slice(F.sequence(F.lit(0), F.lit(ROUNDS)), F.lit(1), _extra(attempt)), lambda i: _pick(_LOWER, _byte(digest, 102 + i))), "")


def _word_name(word: Column, kind: Column, digest: Column, attempt: Column) -> Column:
    """A made-up name in the word's script."""

    def of_script(at: int, sort: str | None = None) -> Column:
        pick = lambda script: F.lit(_SOUNDS[script][at]) if sort is None else F.array(*[F.lit(e) for e in _SOUNDS[script][2][sort]])
        return F.when(word.rlike(r"^\p{IsCyrillic}"), pick("cyrillic")).when(word.rlike(r"^\p{IsGreek}"), pick("greek")).otherwise(pick("latin"))

    def spoken(c: Column, v: Column) -> Column:
        count = F.lit(3) + _byte(digest, 41) % 2 + _extra(attempt)
        syllables = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(_from(c, _byte(digest, 2 * i)), _from(v, _byte(digest, 2 * i + 1))))
        endings = F.when(kind == "given-m", of_script(2, "m")).when(kind == "given-f", of_script(2, "f")).otherwise(of_script(2, "s"))
        return F.initcap(F.concat(F.array_join(syllables, ""), let(endings, lambda e: F.element_at(e, _byte(digest, 40) % F.size(e) + 1))))

    return let(of_script(0), lambda c: let(of_script(1), lambda v: spoken(c, v)))


def _shaped(kind: Column, value: Column, digest: Column, attempt: Column) -> Column:
    """What stays in front, then the same shape; check digits are set by the rest, where those of the value are right."""
    front = (
        F.when(kind == "phone", F.regexp_extract(value, r"^(?:\+(?:1|7|\d{2})|0)", 0))
        .when(kind.isin("card", "ssn"), F.substring(value, 1, 1))
        .when(kind == "iban", F.substring(value, 1, 2))
        .when(kind == "key", F.regexp_extract(value, r"^(?:AKIA|ghp_|sk-)", 0))
        .otherwise("")
    )

    def body(front: Column) -> Column:
        rest = F.substring(value, F.length(front) + 1, F.length(value))
        own = F.when(kind == "card", F.substring(rest, F.lit(1), F.length(rest) - 1)).otherwise(rest)
        return F.concat(F.when(kind == "ssn", "9").otherwise(front), let(own, lambda t: _same_shape(kind, t, digest)))

    last = lambda x: F.when(_luhn_sum(digits_of(value)) % 10 == 0, _check_digit(x)).otherwise((_byte(digest, 100) % 10).cast("string"))
    whole = let(front, body)
    return let(whole, lambda x: F.when(kind == "card", F.concat(x, last(x))).when((kind == "iban") & (_mod97(value) == 1), _valid_iban(x)).when(kind.isin(*FREE), F.concat(x, _added(digest, attempt))).otherwise(x))


def _host(domain: Column, digest: Column, attempt: Column) -> Column:
    """A label of the length of the domain's first one, under a reserved name."""
    top = F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), _byte(digest, 127) % 3 + 1)
    label = F.regexp_extract(F.lower(domain), r"^[^.]+", 0)
    sign = lambda i: F.when(F.substring(label, i + 1, F.lit(1)).rlike("[0-9]"), (_byte(digest, i) % 10).cast("string")).otherwise(_pick(_LOWER, _byte(digest, i)))
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.length(label) - 1), sign), ""), _added(digest, attempt), F.lit(".example."), top)


def _address6(value: Column, digest: Column, attempt: Column) -> Column:
    """An address under the prefix that is reserved for documentation, with as many groups of as many digits, in a late attempt of four."""
    rest = F.regexp_replace(value, r"^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})?(?=:)", "")
    four = lambda i: F.concat(*[_pick("123456789abcdef" if j == 0 else "0123456789abcdef", _byte(digest, i * 4 + j)) for j in range(4)])
    cased = lambda g, x: F.when(g.rlike("[A-F]"), F.upper(x)).otherwise(x)
    group = lambda g, i: cased(g, F.substring(four(i), F.lit(1), F.when(attempt == 0, F.length(g)).otherwise(4)))
    return F.concat(F.lit("2001:db8"), F.array_join(F.transform(F.split(rest, ":", -1), lambda g, i: F.when(g == "", "").otherwise(group(g, i))), ":"))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The replacement of a part; attempt 0 is the usual one, others serve after a collision, from ROUNDS on by number."""
    octet = lambda digest, i: (_byte(digest, i) % 254 + 1).cast("string")

    def of(digest: Column) -> Column:
        reserved = F.concat((_byte(digest, 0) % 14 + 240).cast("string"), *[x for i in (1, 2, 3) for x in (F.lit("."), octet(digest, i))])
        return (
            F.when(attempt >= ROUNDS, F.concat(kind, F.lit("-#"), (attempt - (ROUNDS - 1)).cast("string")))
            .when(kind == "ip", reserved)
            .when(kind == "ip6", _address6(value, digest, attempt))
            .when(kind == "host", _host(value, digest, attempt))
            .when(kind.isin("given-m", "given-f", "surname"), _word_name(value, kind, digest, attempt))
            .otherwise(_shaped(kind, value, digest, attempt))
        )

    return let(_digest(F.lit(key), kind, normal(kind, value), attempt.cast("string")), of)


def part_key(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit("\u0001"), normal(kind, value))


def replacement(value: Column, moved: Column, key: str) -> Column:
    """(kind, new, surnames): a match's type, its replacement and the (old, new) surnames in it. moved maps part keys to attempts."""

    def part(p: Column) -> Column:
        new = let(F.coalesce(moved[part_key(p["kind"], p["value"])], F.lit(0)), lambda attempt: surrogate(p["kind"], p["value"], attempt, key))
        return F.struct(p["kind"].alias("kind"), p["value"].alias("old"), F.when(p["kind"].isNull(), p["value"]).otherwise(new).alias("new"))

    def of(kind: Column) -> Column:
        def built(parts: Column) -> Column:
            glue = F.when(kind == "name", " ").when(kind == "email", "@").otherwise("")
            last = F.transform(F.filter(parts, lambda w: w["kind"] == "surname"), lambda w: F.struct(w["old"].alias("old"), w["new"].alias("new")))
            return F.struct(kind.alias("kind"), F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), parts[0]["new"], lambda t, w: F.concat(t, glue, w["new"])).alias("new"), last.alias("surnames"))

        return let(F.transform(parts_of(kind, value), part), built)

    return let(kind_of(value), of)


def collisions(values: DataFrame, key: str) -> DataFrame | None:
    """(part, attempt), or None without any: the attempts of parts whose usual surrogate is shared or a real part.

    values has the distinct matches in column value. Of parts that share a surrogate the least keeps it; the others, and
    those whose surrogate is a part of the input, try again with the next attempt against all surrogates given so far.
    Late attempts are longer where the kind allows; kinds of fixed length that are full after ROUNDS are numbered.
    """
    v = F.col("value")
    found = values.select(kind_of(v).alias("k"), "value").where("k is not null").select(F.inline(parts_of(F.col("k"), v))).where("kind is not null")
    own = found.withColumn("part", normal(F.col("kind"), v)).groupBy("kind", "part").agg(F.min("value").alias("value"))
    own = cut(own, "pii-parts", narrow=True)
    given, left = None, own.withColumn("attempt", F.lit(0).cast("long"))
    moved = None
    for turn in range(ROUNDS):
        s = surrogate(F.col("kind"), v, F.col("attempt"), key)
        tried = cut(left.withColumn("to", normal(F.col("kind"), s)), "pii-surrogates", narrow=True)
        least = tried.groupBy("kind", "to").agg(F.min("part").alias("keeper"))
        taken = own.select("kind", F.col("part").alias("to")) if given is None else own.select("kind", F.col("part").alias("to")).unionByName(given)
        real = taken.join(least.select("kind", "to"), ["kind", "to"], "left_semi").distinct().withColumn("real", F.lit(True))
        judged = tried.join(least, ["kind", "to"]).join(real, ["kind", "to"], "left")
        again = F.col("real").isNotNull() | (F.col("part") != F.col("keeper"))
        judged = cut(judged.select("kind", "part", "value", "attempt", "to", again.alias("again")), "pii-judged", narrow=True)
        kept = judged.where("not again")
        given = kept.select("kind", "to") if given is None else given.unionByName(kept.select("kind", "to"))
        if turn:
            late = kept.select("kind", "part", "attempt")
            moved = late if moved is None else moved.unionByName(late)
        left = judged.where("again").select("kind", "part", "value", (F.col("attempt") + 1).alias("attempt"))
        if left.isEmpty():
            break
    else:
        numbers = numbered(left, own, given)
        moved = numbers if moved is None else moved.unionByName(numbers)
    return None if moved is None else moved.select(F.concat("kind", F.lit("\u0001"), "part").alias("part"), "attempt")


def numbered(left: DataFrame, own: DataFrame, given: DataFrame) -> DataFrame:
    """(kind, part, attempt): numbers for the parts left, beyond any number that a part or surrogate of the kind holds."""
    used = own.select("kind", F.col("part").alias("x")).unionByName(given.select("kind", F.col("to").alias("x")))
    digits = F.regexp_extract("x", "-#([0-9]{1,17})$", 1)
    most = used.select("kind", digits.alias("d")).where("d <> ''").groupBy("kind").agg(F.max(F.col("d").cast("long")).alias("most"))
    nth, _ = ranked(left.select("kind", "part"), ["kind", "part"], ["kind"], "nth", "pii-left")
    attempt = F.lit(ROUNDS - 1) + F.coalesce("most", F.lit(0)) + F.col("nth")
    return nth.join(most, "kind", "left").select("kind", "part", attempt.cast("long").alias("attempt"))


def rewritten(text: Column, moved: Column, key: str) -> Column:
    """(text, n): the text with its entities replaced, and their number."""
    mark = "\u0001\u0002\u0001"
    once = F.split(F.regexp_replace(text, f"({ANY})", f"{mark}$1{mark}"), mark, -1)  # rest, match, rest, ...
    twice = lambda t: F.zip_with(F.split(t, ANY, -1), F.call_function("regexp_extract_all", t, F.lit(ANY), F.lit(0)), lambda a, b: F.array(a, b))
    apart = F.filter(F.flatten(twice(text)), lambda x: x.isNotNull())
    pieces = F.when(F.contains(text, F.lit("\u0002")), apart).otherwise(once)

    def joined(parts: Column) -> Column:
        each = F.transform(parts, lambda p, i: F.when(i % 2 == 1, replacement(p, moved, key)).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), p.alias("new"), F.array().cast("array<struct<old:string,new:string>>").alias("surnames"))))
        return let(each, told)

    def told(each: Column) -> Column:
        known = F.array_distinct(F.flatten(F.transform(each, lambda x: x["surnames"])))
        alone = lambda s: F.concat(F.lit(r"(?<![\p{L}])"), s["old"], F.lit(r"(?![\p{L}])"))

        def whole(known: Column) -> Column:
            rest = lambda t: F.when(F.size(known) > 0, F.aggregate(known, t, lambda x, s: F.regexp_replace(x, alone(s), s["new"]))).otherwise(t)
            new = F.transform(each, lambda x, i: F.when(i % 2 == 1, x["new"]).otherwise(rest(x["new"])))
            return F.struct(F.array_join(new, "").alias("text"), F.size(F.filter(each, lambda x: x["kind"].isNotNull())).alias("n"))

        return let(known, whole)

    return F.when(hinted(text), let(pieces, joined)).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))


def replaced(docs: DataFrame, key: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with every entity in the text replaced, and the column __entities (their number) added.

    All columns stay, whatever their names but __entities. Null and empty texts stay as they are, repeated rows stay
    repeated, an empty table gives no rows. The key is the setting KEY_SETTING, else a random one of the application.
    Texts that hold a part with another attempt than the usual one are joined, by a hash of the text, to the few that
    the collision check names; if it names none, no text is moved at all.
    """
    key = key or key_of(docs.sparkSession)
    text, before, maps = F.col(f"`{text_col}`"), cuts_so_far(), []
    found = docs.select(F.xxhash64(text).alias("th"), F.array_distinct(matches(text)).alias("values")).where(F.size("values") > 0)
    found = cut(found, "pii-found")
    moved = collisions(found.select(F.explode("values").alias("value")).distinct(), key)
    none = F.create_map().cast("map<string,bigint>")
    attempts = unused(docs.columns, "attempts")
    if moved is None:
        own = docs.withColumn(attempts, none)
    else:
        moved, th = cut(moved, "pii-moved", narrow=True), unused(docs.columns, "hash")
        v = F.col("value")
        parts = found.select("th", F.explode("values").alias("value")).withColumn("k", kind_of(v)).where("k is not null").select("th", F.inline(parts_of(F.col("k"), v))).where("kind is not null")
        where = parts.select("th", part_key(F.col("kind"), v).alias("part")).distinct().join(moved, "part")
        maps = [cut(where.groupBy("th").agg(F.map_from_entries(F.collect_list(F.struct("part", "attempt"))).alias(attempts)).withColumnRenamed("th", th), "pii-maps", narrow=True)]
        own = docs.join(maps[0], F.xxhash64(text) == F.col(th), "left").drop(th).withColumn(attempts, F.coalesce(F.col(attempts), none))
    drop_cuts_since(before, *maps)
    done = unused(docs.columns, "done")
    own = own.withColumn(done, rewritten(text, F.col(attempts), key))
    own = own.withColumn(text_col, F.when(F.col(done)["n"] > 0, F.col(done)["text"]).otherwise(text))
    return own.withColumn("__entities", F.coalesce(F.col(done)["n"], F.lit(0))).drop(done, attempts)


def op2_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """doc_id, text, n_entities for all `documents`, personal data replaced."""
    done = replaced(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "text", F.col("__entities").alias("n_entities"))
