"""Personal data replaced by keyed surrogates of the same type and shape, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import durable

#: Given names that are known, and drawn from, by script and gender. The first lists of each pair also mark a name without a title.
GIVEN = {
    ("latin", "f"): "Alice Anna Clara Elena Emma Helena Ines Julia Laura Lena Maria Marta Nora Paula Rosa Sarah Sofia Teresa Victoria Yvonne Aisha Amelie Ananya Camila Chloe Deepa Elizabeth Fatima Giulia Ingrid Jennifer Katarzyna Leila Lucia Mei Nadia Olivia Priya Yuki Zainab".split(),
    ("latin", "m"): "Adam Bruno Carlos Daniel David Emil Felix Georg Hugo James Jean John Karl Lucas Michael Oscar Pablo Robert Thomas Victor Ahmed Andrzej Antonio Arjun Christopher Diego Fernando Giovanni Hans Hassan Hiroshi Ibrahim Joseph Kwame Lars Mohammed Omar Rajesh Stefan Wei William".split(),
    ("latin", "n"): "Alex Andrea Charlie Dominique Jordan Kim Robin Sascha".split(),
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Мария Ольга Татьяна".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Иван Михаил Николай Павел Сергей".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава".split(),
}
#: Titles by gender; those of any gender last.
TITLES = {"f": "Mrs Ms Miss Mme Mlle Frau Sra Srta Señora Signora Г-жа г-жа".split(), "m": "Mr Herr Sr Señor Signor Monsieur Г-н г-н".split(), "n": "Dr Prof".split()}
CONSONANTS, VOWELS = {"latin": "bdfgklmnprstvz", "cyrillic": "бвгдклмнпрстз"}, {"latin": "aeiou", "cyrillic": "аеиоу"}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
NUMBERS = ("card", "ssn", "phone")
#: From this attempt on a surrogate grows by a character each time, so that no space of a shape is ever too small.
GROWS = 8

_name = r"\p{Lu}(?:['’]\p{Lu})?\p{L}*\p{Ll}(?:-\p{Lu}\p{L}+)?"
_titles = "|".join(t for ts in TITLES.values() for t in ts)
_given = "|".join(n for (_, g), ns in GIVEN.items() if g != "n" for n in ns)
_h = "[0-9A-Fa-f]{1,4}"
#: Kinds in order of precedence at one place; each pattern stands by itself. No repeated group can back up (possessive), so no
#: pattern recurses on long texts, and none is tried twice within one run of an address's characters.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[._%+\-]*+[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++",
    "secret": r"(?<=[\"'])(?<=(?:token|secret|passwd|password|api_key|apikey|TOKEN|SECRET|PASSWORD|API_KEY|Token|Secret|Password)\s{0,3}[=:]\s{0,3}[\"'])[^\"'\s]{6,}+|(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}+)(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])sk-[0-9A-Za-z\-]{20,}+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_h}:){{7}}{_h}|[0-9A-Fa-f]{{4}}(?::{_h}){{0,5}}::(?:{_h}(?::{_h}){{0,5}})?)(?![\p{{L}}\p{{N}}]|:[0-9A-Fa-f])",
    "ip": r"(?<![\p{L}\p{N}.])(?<![Vv]ersion )(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "card": r"(?<![\p{L}\p{N}.\-])(?!97[89][ \-]?\d|\d{13}(?!\d))\d(?:[ \-]?\d){12,18}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "phone": r"(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|(?<![\p{L}\p{N}.\-])\d{3}[.\-]\d{3}[.\-]\d{4})(?![\p{L}\p{N}])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_titles})\.? {_name}(?: {_name})?|(?:{_given}) {_name})(?![\p{{L}}\p{{N}}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has: a digit, an at sign, a quoted secret, a key or hex string of letters alone, or a title or known name before a capital.
GATE = rf"[@0-9]|(?:=|:)\s{{0,3}}[\"']|AKIA[A-Z]{{16}}|gh[pousr]_[A-Za-z]{{36}}|sk-[A-Za-z\-]{{20}}|[a-f]{{32}}|[A-F]{{32}}|(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}}|г)(?:{_titles}|{_given})\.? \p{{Lu}}"
#: A capitalised word, which may be a name on its own.
LONE = r"(?<![\p{L}\p{N}])\p{Lu}(?:['’]\p{Lu})?\p{L}*+(?:-\p{Lu}\p{L}++)?"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, whatever the number of places that it is used in."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _kind(m: Column) -> Column:
    """Which kind a found text is of: the first whose shape it has (context was checked where it was found)."""
    digits = F.length(F.regexp_replace(m, r"\D", ""))
    return (
        F.when(m.contains("@") & m.rlike(rf"^(?:{PATTERNS['email']})$"), "email")
        .when(m.rlike(r"^(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)$"), "hex")
        .when(m.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]{8,}$"), "iban")
        .when(m.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip")
        .when(m.rlike(rf"^(?:{PATTERNS['ip6']})$"), "ip6")
        .when(m.rlike(r"^\d(?:[ \-]?\d){12,18}$"), "card")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[+(\d][\d ().\-]+$") & (digits >= 7) & (digits <= 20), "phone")
        .when(m.rlike(rf"^(?:(?:{_titles})\.? {_name}(?: {_name})?|(?:{_given}) {_name})$"), "person")
        .otherwise("secret")
    )


def _script(s: Column) -> Column:
    return F.when(s.rlike(r"\p{IsCyrillic}"), "cyrillic").when(s.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


# --- what is kept of a part: a keyed digest and its shape, never the part itself


def digest(key: str, kind: Column, norm: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm), 256)


def _classes(s: Column) -> Column:
    """One letter or digit for all of a class and script."""
    for pattern, one in ((r"\p{Nd}", "0"), (r"[\p{L}&&\p{IsCyrillic}]", "б"), (r"[\p{L}&&\p{IsGreek}]", "α"), ("[\\p{L}&&[^бα]]", "a")):
        s = F.regexp_replace(s, pattern, one)
    return s


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 (0: a valid number)."""
    n = F.length(digits)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 1, 2).otherwise(1))
    return F.pmod(F.aggregate(terms, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)), F.lit(10))


def shape(kind: Column, norm: Column) -> Column:
    """All that a surrogate takes from its part: classes of characters; of numbers the first digit, of cards the Luhn sum, of accounts the country."""
    n = F.length(norm)
    plain = F.concat(F.substring(norm, 1, 1), F.repeat(F.lit("0"), n - 1))
    card = F.concat(F.substring(plain, F.lit(1), n - 1), F.pmod(_luhn(norm) - _luhn(plain), F.lit(10)).cast("string"))
    return F.when(kind == "card", card).when(kind.isin(*NUMBERS), plain).when(kind == "iban", F.concat(F.substring(norm, 1, 2), _classes(F.substring(norm, F.lit(3), n)))).otherwise(_classes(norm))


# --- drawing


def _blocks(mark: Column, attempt: Column, n: Column) -> Column:
    """array<string> of 64 keyed hex digits each, enough for n draws and 64 more."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(n, 4) + 4), lambda i: F.sha2(F.concat_ws("\x1f", mark, attempt.cast("string"), i.cast("string")), 256))


def _draw(h: Column, i: Column | int, n: Column | int) -> Column:
    """The i-th draw below n: four hex digits each, 16 of them a block."""
    i = F.lit(i) if isinstance(i, int) else i
    block = F.element_at(h, F.pmod(F.shiftright(i, 4), F.size(h)) + 1)
    return F.pmod(F.conv(F.substring(block, F.pmod(i, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(n) if isinstance(n, int) else n)


def _pick(alphabet: str, k: Column) -> Column:
    return F.substring(F.lit(alphabet), k + 1, F.lit(1))


def _more(attempt: Column, h: Column) -> Column:
    """Hex digits put behind a surrogate whose shape has run out of free values."""
    return F.substring(F.element_at(h, -1), F.lit(1), F.greatest(F.lit(0), attempt - GROWS + 1))


def _redrawn(value: Column, h: Column, hexadecimal: Column) -> Column:
    """Each character replaced by one of its class, script and case; others stay."""

    def one(c: Column, i: Column) -> Column:
        script = _script(c)
        letters = F.when(hexadecimal, "abcdef").when(script == "cyrillic", LETTERS["cyrillic"]).when(script == "greek", LETTERS["greek"]).otherwise(LETTERS["latin"])
        letter = _let(letters, lambda a: F.substring(a, _draw(h, i, F.length(a)) + 1, F.lit(1)))
        return F.when(c.rlike(r"\p{Nd}"), _draw(h, i, 10).cast("string")).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(_chars(value), one), "")


def _numbers(kind: Column, digits: Column, h: Column, more: Column) -> Column:
    """Digits for digits. Cards keep their first digit and their Luhn sum, so a valid one stays valid; numbers with a country code keep its first digit."""
    new = F.array_join(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: _draw(h, i, 10).cast("string")), "")

    def card(new: Column) -> Column:
        body = F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.substring(new, F.lit(2), F.length(digits) - 2))
        return _let(body, lambda b: F.concat(b, F.pmod(_luhn(digits) - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    coded = (kind == "phone") & (F.length(digits) > 10)
    own = F.when(kind == "card", _let(new, card)).when(coded, F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.substring(new, F.lit(2), F.length(digits)))).otherwise(new)
    return F.concat(own, F.translate(more, "abcdef", "012345"))


def _mod97(s: Column) -> Column:
    """The number that an account's letters (a = 10) and digits spell, modulo 97."""
    step = lambda a, c: F.when(c.between("0", "9"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 87, F.lit(97)))
    return F.aggregate(_chars(s), F.lit(0), step)


def _account(mask: Column, h: Column, more: Column) -> Column:
    """Same country, valid check digits, the rest redrawn."""
    rest = F.concat(_redrawn(F.substring(mask, F.lit(5), F.length(mask)), h, F.lit(False)), more)
    country = F.substring(mask, 1, 2)
    return _let(rest, lambda r: F.concat(country, F.lpad((98 - _mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0"), r))


def _from_list(names: list[str], h: Column, attempt: Column) -> Column:
    """One name, joined by one more with every attempt: a short list gives any number of distinct names."""
    return F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: F.element_at(F.array(*map(F.lit, names)), _draw(h, i, len(names)) + 1)), "-")


def _syllables(script: str, h: Column, attempt: Column) -> Column:
    c, v = CONSONANTS[script], VOWELS[script]
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3) + F.least(attempt, F.lit(20))), lambda i: F.concat(_pick(c, _draw(h, 2 * i, len(c))), _pick(v, _draw(h, 2 * i + 1, len(v))))), "")


def surrogate(kind: Column, mask: Column, mark: Column, attempt: Column) -> Column:
    """The surrogate of a part with this shape and keyed digest: equal parts get equal ones, whatever their case or separators in the text.

    Kinds of parts: mailbox and host (of an address), ip, ip6, secret, hex, iban, card/ssn/phone (digits), given_<gender>, surname.
    Hosts lie below example.org, IPv4 addresses in the reserved 240.0.0.0/4 (in the IPv6 range once attempts grow), IPv6 ones in 2001:db8::/32.
    """
    return _let(_blocks(mark, attempt, F.length(mask)), lambda h: _by_kind(kind, mask, attempt, h))


def _by_kind(kind: Column, mask: Column, attempt: Column, h: Column) -> Column:
    more = _more(attempt, h)
    ip = F.concat_ws(".", (_draw(h, 0, 16) + 240).cast("string"), *((_draw(h, i, 256)).cast("string") for i in (1, 2)), (_draw(h, 3, 254) + 1).cast("string"))
    ip6 = F.concat(F.lit("2001:db8:"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(F.element_at(h, 2), 4 * i + 1, F.lit(4))), ":"))
    script, no = _script(mask), F.lit(False)
    given = F.lit(None).cast("string")
    for (s, g), names in GIVEN.items():
        given = F.when((kind == f"given_{g}") & (script == s), _from_list(names, h, attempt)).otherwise(given)
    given = F.coalesce(given, _title(F.concat(_redrawn(mask, h, no), F.when(attempt >= GROWS, F.regexp_replace(more, r"\d", "o")).otherwise(""))))
    surname = F.lit(None).cast("string")
    for s in CONSONANTS:
        surname = F.when(script == s, F.concat(F.initcap(_syllables(s, h, attempt)), F.lit("n" if s == "latin" else "н"))).otherwise(surname)
    surname = F.coalesce(surname, _title(F.concat(_redrawn(mask, h, no), F.regexp_replace(more, r"\d", "o"))))
    host = F.concat(_redrawn(F.element_at(F.split(mask, r"\."), 1), h, no), F.lit("-"), F.substring(F.element_at(h, 3), F.lit(1), F.lit(6)), more, F.lit(".example.org"))
    return (
        F.when(kind == "ip", F.when(attempt >= GROWS, ip6).otherwise(ip)).when(kind == "ip6", ip6).when(kind == "host", host).when(kind.startswith("given"), given).when(kind == "surname", surname)
        .when(kind.isin(*NUMBERS), _numbers(kind, mask, h, more)).when(kind == "iban", _account(mask, h, more)).otherwise(F.concat(_redrawn(mask, h, kind == "hex"), more))
    )


def _title(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, F.lit(1), F.lit(1))), F.substring(s, F.lit(2), F.length(s)))


# --- from texts to parts and back


def _head(m: Column) -> Column:
    """A person's title with what stands after it, or nothing."""
    return F.regexp_extract(m, rf"^(?:{_titles})\.? ", 0)


def _names(m: Column) -> Column:
    """A person's names without the title."""
    return F.split(F.substring(m, F.length(_head(m)) + 1, F.length(m)), " ")


def _gender(m: Column) -> Column:
    title = F.regexp_extract(m, rf"^({_titles})\.? ", 1)
    first = F.element_at(_names(m), 1)
    known = {g: [n for (_, x), ns in GIVEN.items() if x == g for n in ns] for g in "fm"}
    return F.when(title.isin(TITLES["f"]), "f").when(title.isin(TITLES["m"]), "m").when(first.isin(known["f"]), "f").when(first.isin(known["m"]), "m").otherwise("n")


def _long_form(m: Column) -> Column:
    """An IPv6 address with all its eight groups of four digits."""
    side = lambda i: F.filter(F.split(F.coalesce(F.get(F.split(m, "::"), i), F.lit("")), ":"), lambda g: g != "")
    groups = F.concat(side(0), F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(side(0)) - F.size(side(1)))), side(1))
    return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ":")


def _mailbox(m: Column) -> Column:
    """An address without the marks that stand before it."""
    return F.regexp_replace(m, r"^[._%+\-]+", "")


def _parts(m: Column, kind: Column) -> Column:
    """array<struct<kind, norm>> of what a found text is made of. A lone name after a title is a surname."""
    part = lambda k, v: F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), v.alias("norm"))
    at = F.split(F.lower(_mailbox(m)), "@")
    names = F.transform(_names(m), F.lower)
    both = F.array(part(F.concat(F.lit("given_"), _gender(m)), F.element_at(names, 1)), part("surname", F.element_at(names, -1)))
    return (
        F.when(kind == "email", F.array(part("mailbox", F.element_at(at, 1)), part("host", F.element_at(at, -1))))
        .when(kind == "person", F.when(F.size(names) == 1, F.array(part("surname", F.element_at(names, 1)))).otherwise(both))
        .when(kind.isin(*NUMBERS), F.array(part(kind, F.regexp_replace(m, r"\D", ""))))
        .when(kind == "iban", F.array(part(kind, F.lower(F.regexp_replace(m, " ", "")))))
        .when(kind == "ip6", F.array(part(kind, _long_form(F.lower(m)))))
        .otherwise(F.array(part(kind, F.lower(m))))
    )


def _refill(value: Column, new: Column, kept: str) -> Column:
    """``value`` with its characters, but for those of the class ``kept``, replaced by those of ``new`` in order; what is left over comes last."""
    bare = lambda s: F.length(F.regexp_replace(s, kept, ""))
    filled = F.transform(_chars(value), lambda c, i: F.when(c.rlike(kept), c).otherwise(F.substring(new, bare(F.substring(value, F.lit(1), i)) + 1, F.lit(1))))
    return F.concat(F.array_join(filled, ""), F.substring(new, bare(value) + 1, F.length(new)))


def _cased(new: Column, old: Column) -> Column:
    """``new`` with capitals where ``old`` has them."""
    return F.array_join(F.zip_with(_chars(new), _chars(old), lambda c, o: F.when(o != F.lower(o), F.upper(c)).otherwise(c)), "")


def _of(key: str, part: Column, attempts: Column) -> Column:
    """A part's surrogate. ``attempts``: map<digest, int> of parts whose first surrogate was taken."""
    return _let(digest(key, part["kind"], part["norm"]), lambda mark: surrogate(part["kind"], shape(part["kind"], part["norm"]), mark, F.coalesce(F.try_element_at(attempts, mark), F.lit(0))))


def _told(key: str, m: Column, attempts: Column) -> Column:
    """struct<m, kind, said>: a found text, its kind, and its parts' surrogates."""
    said = lambda kind: F.transform(_parts(m, kind), lambda p: _of(key, p, attempts))
    return _let(_kind(m), lambda kind: F.struct(m.alias("m"), kind.alias("kind"), said(kind).alias("said")))


def _written(told: Column) -> Column:
    """What a found text is replaced by."""
    m, kind, said = told["m"], told["kind"], told["said"]
    plain = F.element_at(said, 1)
    new = (
        F.when(kind == "email", F.concat(F.regexp_extract(m, r"^[._%+\-]*", 0), F.concat_ws("@", said))).when(kind == "person", F.concat(_head(m), F.array_join(said, " ")))
        .when(kind.isin(*NUMBERS), _refill(m, plain, r"\D")).when(kind == "iban", _refill(m, F.upper(plain), " ")).when(kind.isin("ip", "ip6"), plain).otherwise(_cased(plain, m))
    )
    return _let(new, lambda n: F.when((m == F.upper(m)) & (m != F.lower(m)), F.upper(n)).otherwise(n))


def _people(told: Column) -> Column:
    """array<struct<name, new>>: the names of a text's persons as they are written, each once, and what they become."""
    each = F.transform(F.filter(told, lambda t: t["kind"] == "person"), lambda t: F.zip_with(_names(t["m"]), t["said"], lambda n, s: F.struct(n.alias("name"), s.alias("new"))))
    return _let(F.flatten(each), lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda x: x["name"])), lambda n: F.struct(n.alias("name"), F.element_at(F.filter(all_, lambda x: x["name"] == n), 1)["new"].alias("new"))))


def _lone(segment: Column, people: Column) -> Column:
    """A stretch between entities with the lone names of ``people`` (map<name, new>) replaced."""
    kept = F.zip_with(F.split(segment, LONE, -1), F.regexp_extract_all(segment, F.lit(LONE), 0), lambda a, w: F.concat(a, F.coalesce(F.try_element_at(people, w), w, F.lit(""))))
    return F.array_join(kept, "")


def mentions(docs: DataFrame, key: str) -> DataFrame:
    """(text_hash, kind, shape, mark): the distinct parts of each text's entities, as keyed digests."""
    found = docs.filter(F.col("text").rlike(GATE)).select(F.xxhash64("text").alias("text_hash"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ANY), 0))).alias("m"))
    parts = found.select("text_hash", F.explode(_let(_kind(F.col("m")), lambda kind: _parts(F.col("m"), kind))).alias("p"))
    return parts.select("text_hash", "p.kind", shape(F.col("p.kind"), F.col("p.norm")).alias("shape"), digest(key, F.col("p.kind"), F.col("p.norm")).alias("mark"))


def dictionary(found: DataFrame, key: str) -> DataFrame:
    """(kind, shape, mark, attempt): every distinct part of ``found(kind, shape, mark)``, with the attempt at which no two of a kind share a surrogate and none equals a real part.

    Where a surrogate is taken, all but its smallest part try again with the next attempt, until a round finds none; from the attempt
    ``GROWS`` on surrogates grow, so that the rounds end even where a shape has fewer values than parts. Parts are
    folded before the shuffle, so one part that fills a third of all texts is one row a task.
    """
    now = found.select("kind", "shape", "mark").distinct().withColumn("attempt", F.lit(0))
    drawn = F.lower(surrogate(F.col("kind"), F.col("shape"), F.col("mark"), F.col("attempt")))
    said = digest(key, F.col("kind"), F.when(F.col("kind") == "ip6", _long_form(F.col("said"))).otherwise(F.col("said")))  # one expression for all rounds
    while True:
        now = durable(now.withColumn("said", drawn).withColumn("said", said))
        first = now.groupBy("said").agg(F.min("mark").alias("first"), F.count("*").alias("m"))
        real = now.select(F.col("mark").alias("said"), F.lit(True).alias("real"))
        taken = first.join(real, "said", "left").filter((F.col("m") > 1) | F.col("real")).select("said", F.when(F.col("real"), F.lit(None)).otherwise(F.col("first")).alias("keeps"), F.lit(True).alias("taken"))
        if not taken.limit(1).count():
            return now.drop("said")
        attempt = F.col("attempt") + F.when(F.col("taken") & ~F.col("mark").eqNullSafe(F.col("keeps")), 1).otherwise(0)
        now = now.join(taken, "said", "left").select("kind", "shape", "mark", attempt.alias("attempt"))


#: Texts with a part whose first surrogate was taken are broadcast up to this number (a hash and a few digests each).
FEW = 100_000


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and ``n_entities``; n_chars, where there is one, follows the new text.

    Surrogates are functions of key and part alone, but for parts whose first surrogate was taken: their attempts come to the texts that
    hold them by a join on the text's hash (broadcast while few texts need it), so repeated or null ids gather nothing. Texts are cut
    at the entities and joined again. Addresses, names with title or known given name (gender and script kept, surname
    shared by coreferent mentions; the same names standing alone in that text go too), phones, cards (Luhn kept), social security numbers, account
    numbers (country and check digits kept valid), IP addresses and secrets are entities. ``n_entities`` counts those found by their own shape.
    Nothing that is written between the steps holds a part, only its keyed digest and shape. Null texts stay null, null and repeated ids
    keep their rows, an empty table gives an empty one, and all other columns stay.
    """
    docs = docs.select(*(c for c in docs.columns if c != "n_entities"))
    found = durable(mentions(docs, key).distinct())
    spared = dictionary(found, key).filter("attempt > 0").select("mark", "attempt")
    again = found.join(spared, "mark").groupBy("text_hash").agg(F.map_from_entries(F.collect_list(F.struct("mark", "attempt"))).alias("again"))
    again = durable(again)
    again = F.broadcast(again) if again.count() <= FEW else again
    # a row travels in one struct, so none of its columns meets one of these steps
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("t"))
    gate = F.coalesce(F.col("t").rlike(GATE), F.lit(False))
    held = rows.filter(gate).withColumn("text_hash", F.xxhash64("t")).join(again, "text_hash", "left").withColumn("found", F.regexp_extract_all("t", F.lit(ANY), 0))
    held = held.withColumn("told", F.transform("found", lambda m: _told(key, m, F.col("again"))))
    cut = F.split("t", ANY, -1)
    segments = _let(_people(F.col("told")), lambda p: F.when(F.size(p) == 0, cut).otherwise(_let(F.map_from_entries(p), lambda known: F.transform(cut, lambda s: _lone(s, known)))))
    joined = F.array_join(F.zip_with(segments, F.transform("told", _written), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    held = held.select("row", F.when(F.size("found") > 0, joined).otherwise(F.col("t")).alias("t"), F.size("found").alias("n"))
    done = held.unionByName(rows.filter(~gate).select("row", "t", F.lit(0).alias("n")))
    new = {"text": F.col("t"), "n_chars": F.coalesce(F.length("t").cast("long"), F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return done.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns), F.col("n").alias("n_entities"))
