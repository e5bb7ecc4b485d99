"""Replacing personal data by keyed surrogates.

One regular expression finds all entities of a text. A surrogate is derived from a secret key, the entity's type and its
canonical form, so an entity gets the same one wherever and however it is written; it keeps the entity's format: digits
stay digits, letters stay letters of the same case and script, and names keep the gender that their title tells.

Numbers of a fixed format (phones, cards, social security numbers, network addresses) are permuted within their format by a
keyed Feistel network, so two never meet. Other entities draw; a person's name draws word by word, so a family name is the same with
and without a first name, for men and women. Two entities whose draws meet, or a draw that is itself an entity of the
corpus, are found over all documents; those entities draw again, from a greater space each time, until all differ. Only documents that
hold one of them are joined with the draws; a Bloom filter lets the others pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BITMAP_BITS, bitmaps, let, looked_up, power_of_two, written

# Titles, and what entities look like. The order of kinds decides where two would start at one place.
WOMEN = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Sra|Госпожа"
MEN = "Mr|Herr|Monsieur|Señor|Sr|Господин"
OTHERS = "Dr|Prof|Professor|Доктор"
_NAMES = r"""\x20\p{Lu}[\p{L}'-]{1,30}(?:\x20\p{Lu}[\p{L}'-]{1,30}){0,2}+"""
_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "secret": r"""(?=[TtSsPpAa])(?<![A-Za-z])(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)[\"']?\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9+/_-]{16,128}""",
    "access_key": r"""(?=[Agsxe])(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|sk-[A-Za-z0-9_-]{20,128}|xox[abprs]-[A-Za-z0-9-]{10,128}|eyJ[A-Za-z0-9_-]{8,1024}\.[A-Za-z0-9_-]{8,4096}\.[A-Za-z0-9_-]{8,1024})(?![A-Za-z0-9])""",
    "email": r"""(?<![A-Za-z0-9À-ɏ_%+-])(?<![A-Za-z0-9À-ɏ_%+-]\.)[A-Za-z0-9À-ɏ_%+-]++(?:\.[A-Za-z0-9À-ɏ_%+-]++){0,15}+@(?:[A-Za-z0-9À-ɏ-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])""",
    "iban": r"""(?=[A-Z]{2}[0-9])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])""",
    "ip6": r"""(?=[0-9A-Fa-f]{1,4}:)(?<![A-Za-z0-9:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![A-Za-z0-9:])""",
    "ip": rf"""(?<![0-9.])(?:{_BYTE}\.){{3}}{_BYTE}(?![0-9]|\.[0-9])""",
    "card": r"""(?<![0-9])(?:(?:[0-9]{4}[\x20-]?){3}[0-9]{4}|3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})(?![0-9])""",
    "ssn": r"""(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])""",
    "phone": r"""(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[\x20.-]?)?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}|\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,4}|(?<![.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|(?<![.,:/-])0[1-9](?:[\x20.][0-9]{2}){4}|(?<![.,:/-])0[1-9][0-9]{1,3}[\x20/-][0-9]{6,8})(?![0-9])""",
    "woman": rf"""(?=[MFSГ])(?<!\p{{L}})(?:{WOMEN})\.?{_NAMES}""",
    "man": rf"""(?=[MHSГ])(?<!\p{{L}})(?:{MEN})\.?{_NAMES}""",
    "person": rf"""(?=[DPД])(?<!\p{{L}})(?:{OTHERS})\.?{_NAMES}""",
}
PEOPLE = ("woman", "man", "person")
#: Kinds that are permuted within their format.
PERMUTED = ("ip", "card", "ssn", "phone")
TITLE = rf"^(?:{WOMEN}|{MEN}|{OTHERS})\.?\x20"
SECRET_NAME = r"""^[A-Za-z_-]+["']?\s{0,2}[=:]\s{0,2}["']?"""


def _any(email: tuple[str, ...]) -> str:
    """All kinds, parted by what they can begin with, so that most places of a text are passed by at once."""
    letters, digits = ("secret", "access_key", *email, "iban", "ip6", *PEOPLE), (*email, "ip6", "ip", "card", "ssn", "phone")
    return rf"(?<![A-Za-zÀ-ӿ])(?:{'|'.join(PATTERNS[k] for k in letters)})|(?=[0-9+(])(?:{'|'.join(PATTERNS[k] for k in digits)})"


ANY, WITHOUT_EMAIL = _any(("email",)), _any(())
#: Stands around entities while a text is cut up; characters of private use.
EDGE = "\uf8e1\uf8d7"
# Country codes of one and two digits; all others have three.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
# Syllables that names are made of, and their last letters by gender, which no syllable is or ends in.
LATIN = ["ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "ta", "ve", "wi", "ka", "le", "mi", "no"]
CYRILLIC = ["ба", "де", "фи", "го", "лу", "ма", "не", "ри", "со", "та", "ве", "ви", "ка", "ле", "ми", "но"]
LAST = {("woman", False): "na", ("man", False): "n", ("woman", True): "на", ("man", True): "н"}
DOMAINS = ["example.com", "example.net", "example.org"]
SYLLABLES = 4  # of a name's first draw; each further draw has one more
ROUNDS = 8  # of the Feistel network


def kind_of(entity: Column) -> Column:
    """The type whose pattern matches the whole entity first; null for a card number whose check sum is wrong."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        which = F.when(_luhn(_digits(entity)) == 0, name) if name == "card" else F.lit(name)
        found = F.when(entity.rlike(f"^(?:{pattern})$"), which).otherwise(found)
    return found


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def value_of(kind: Column, entity: Column) -> Column:
    """What identifies the entity: a secret without its name, a person without the title."""
    return F.when(kind == "secret", F.regexp_replace(entity, SECRET_NAME, "")).when(kind.isin(*PEOPLE), F.regexp_replace(entity, TITLE, "")).otherwise(entity)


def canonical(kind: Column, entity: Column) -> Column:
    """One form for all ways to write an entity: case of addresses and accounts, marks within numbers."""
    value = value_of(kind, entity)
    plain = F.when(kind.isin("card", "ssn"), _digits(value)).when(kind == "phone", F.regexp_replace(value, "[^0-9+]", "")).when(kind == "iban", F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", "")))
    return plain.when(kind.isin("email", "ip6", "word", *PEOPLE), F.lower(value)).otherwise(value)


def _number(stream: Column, at: Column | int) -> Column:
    """A number below 256 from two hexadecimal digits of the stream."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substr(stream, F.pmod(2 * at, F.char_length(stream)) + 1, F.lit(2)), 16, 10).cast("int")


def _big(stream: Column, at: int) -> Column:
    """A number below 2**56."""
    return F.conv(F.substr(stream, F.lit(at), F.lit(14)), 16, 10).cast("long")


def _pick(items: list[str] | str, n: Column) -> Column:
    """The item number n, round and round."""
    if isinstance(items, str):
        return F.substr(F.lit(items), F.pmod(n, F.lit(len(items))) + 1, F.lit(1))
    return F.get(F.array(*map(F.lit, items)), F.pmod(n, F.lit(len(items))))


def _poured(value: Column, stream: Column, kept: Column | int = 0) -> Column:
    """Every digit and letter but the first kept ones drawn anew within its kind; marks stay. The k-th digit or letter takes
    the k-th number of the stream, whatever marks are between, so all ways to write a number get the same digits."""
    kept = F.lit(kept) if isinstance(kept, int) else kept
    hexadecimal = value.rlike("^[0-9a-fA-F:]+$")

    def step(state: Column, c: Column) -> Column:
        n = _number(stream, state["k"])
        drawn = (
            F.when(state["k"] < kept, c).when(c.rlike("[0-9]"), _pick("0123456789", n)).when(hexadecimal & c.rlike("[a-f]"), _pick("abcdef", n)).when(hexadecimal & c.rlike("[A-F]"), _pick("ABCDEF", n))
            .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", n)).when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).otherwise(_pick("éèüöñáóçäß", n))
        )
        counts = c.rlike(r"[\p{L}0-9]")
        return F.struct(F.concat(state["text"], F.when(counts, drawn).otherwise(c)).alias("text"), (state["k"] + counts.cast("int")).alias("k"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("text"), F.lit(0).alias("k")), step, lambda s: s["text"])


def _luhn(digits: Column) -> Column:
    """The Luhn sum, modulo 10, of a number whose last digit is the check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, d: a + d), F.lit(10))


def _feistel(left: Column, right: Column, most_left: Column, most_right: Column, key: Column) -> Column:
    """struct(l, r): a permutation of the pairs of numbers below most_left and most_right, which the key chooses."""
    pseudo = lambda i, x: F.conv(F.substr(F.sha2(F.concat_ws("\x1f", key, i.cast("string"), x.cast("string")), 256), F.lit(1), F.lit(14)), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        to_left = F.when(odd, s["l"]).otherwise(F.pmod(s["l"] + pseudo(i, s["r"]), most_left))
        to_right = F.when(odd, F.pmod(s["r"] + pseudo(i, s["l"]), most_right)).otherwise(s["r"])
        return F.struct(to_left.alias("l"), to_right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _permuted(digits: Column, key: Column) -> Column:
    """As many digits, by a permutation of all numbers of that length."""
    n = F.char_length(digits)
    half = F.ceil(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10), k).cast("long")
    left, right = F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, n - half)
    made = _feistel(left, F.when(n > half, right).otherwise("0"), power(half), power(n - half), F.concat_ws("\x1f", key, n.cast("string")))
    padded = lambda x, k: F.when(k > 0, F.lpad(x.cast("string"), k, "0")).otherwise("")
    return let(made, lambda x: F.concat(padded(x["l"], half), padded(x["r"], n - half)))


def _written_as(value: Column, digits: Column) -> Column:
    """The digits in the places of the value's digits."""
    step = lambda s, c: F.struct(F.concat(s["text"], F.when(c.rlike("[0-9]"), F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("text"), (s["k"] + c.rlike("[0-9]").cast("int")).alias("k"))
    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("text"), F.lit(1).alias("k")), step, lambda s: s["text"])


def _number_in_format(kind: Column, value: Column, secret: str) -> Column:
    """A phone, a card or a social security number of the same format. A country's code stays, or a leading zero, and a
    card's first digit; a card's last digit makes the check sum right."""
    digits = _digits(value)
    kept = F.when(kind == "card", F.substr(digits, F.lit(1), F.lit(1))).when(value.startswith("+"), F.regexp_extract(digits, COUNTRY, 0)).when(digits.startswith("0") & (kind == "phone"), F.lit("0")).otherwise("")
    card = (kind == "card").cast("int")
    inner = F.substr(digits, F.char_length(kept) + 1, F.char_length(digits) - F.char_length(kept) - card)
    key = F.concat_ws("\x1f", F.lit(secret), kind, value.startswith("+").cast("string"), kept)
    made = let(F.concat(kept, _permuted(inner, key)), lambda x: F.when(kind == "card", F.concat(x, F.pmod(10 - _luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string"))).otherwise(x))
    return let(made, lambda x: _written_as(value, x))


def _address(value: Column, secret: str) -> Column:
    """A network address by a permutation; the first byte stays within 1 to 223 if it was, else as it is."""
    bytes_ = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))

    def made(b: Column) -> Column:
        turn = F.conv(F.substr(F.sha2(F.lit(f"{secret}\x1fip"), 256), F.lit(1), F.lit(7)), 16, 10).cast("long")
        first = F.when(F.get(b, F.lit(0)).between(1, 223), F.pmod(F.get(b, F.lit(0)) - 1 + turn, F.lit(223)) + 1).otherwise(F.get(b, F.lit(0)))
        rest = F.get(b, F.lit(1)) * 65_536 + F.get(b, F.lit(2)) * 256 + F.get(b, F.lit(3))
        pair = _feistel(F.shiftright(rest, 12), rest.bitwiseAND(F.lit(4095)), F.lit(4096), F.lit(4096), F.concat_ws("\x1f", F.lit(secret), F.lit("ip"), F.get(b, F.lit(0)).cast("string")))
        joined = lambda x: F.concat_ws(".", first.cast("string"), *(F.shiftright(x, k).bitwiseAND(F.lit(255)).cast("string") for k in (16, 8, 0)))
        return let(pair, lambda p: let(p["l"] * 4096 + p["r"], joined))

    return let(bytes_, made)


def _word(word: Column, secret: str, draw: Column) -> Column:
    """A name's word as syllables of the same script, lower-cased; each further draw has a syllable more."""
    stream = F.sha2(F.concat_ws("\x1f", F.lit(secret), F.lit("name"), F.lower(word), draw.cast("string")), 256)
    spelt = lambda x: F.transform(F.sequence(F.lit(0), draw + (SYLLABLES - 1)), lambda k: F.when(word.rlike(r"\p{IsCyrillic}"), _pick(CYRILLIC, _number(x, k))).otherwise(_pick(LATIN, _number(x, k))))
    return let(stream, lambda x: F.array_join(spelt(x), ""))


def _name(kind: Column, value: Column, secret: str, draws: Column) -> Column:
    """The words of a name, each drawn by itself; all but the last of several end as the gender does."""
    words = F.split(value, " ")

    def word(x: Column, i: Column) -> Column:
        ending = lambda script: F.when(kind == "woman", LAST["woman", script]).when(kind == "man", LAST["man", script]).otherwise("")
        last = F.when(i == F.size(words) - 1, "").otherwise(F.when(x.rlike(r"\p{IsCyrillic}"), ending(True)).otherwise(ending(False)))
        return let(_draw(draws, F.lit("word"), F.lower(x)), lambda n: F.initcap(F.concat(_word(x, secret, n), last)))

    return F.array_join(F.transform(words, word), " ")


def _draw(draws: Column, kind: Column, form: Column) -> Column:
    """The number of an entity's draw: 0, unless the map says otherwise."""
    return F.coalesce(F.try_element_at(draws, F.concat_ws("\x1f", kind, form)), F.lit(0))


def _drawn(kind: Column, form: Column, value: Column, draw: Column, secret: str) -> Column:
    """The draw of an entity that isn't permuted, as the value is written."""
    seed = F.concat_ws("\x1f", F.lit(secret), kind, form, draw.cast("string"))
    stream = lambda x: F.concat(*(F.sha2(F.concat(x, F.lit(f"\x1f{k}")), 256) for k in range(4)))

    def made(stream: Column) -> Column:
        local = F.regexp_replace(value, "@.*$", "")
        # Drawn again, an address has more numbers to choose from.
        domain = F.concat(F.lit("@mail"), F.pmod(_big(stream, 120), F.pow(F.lit(10), F.least(draw, F.lit(10)) + 5).cast("long")).cast("string"), F.lit("."), _pick(DOMAINS, _number(stream, 70)))
        email = let(F.concat(_poured(F.lower(local), stream), domain), lambda x: F.when((F.upper(local) == local) & (F.lower(local) != local), F.upper(x)).otherwise(x))
        keys = _poured(value, stream, F.when(value.rlike("^A[KS]IA|^xox"), 4).when(value.startswith("sk"), 2).otherwise(3))
        return F.when(kind == "email", email).when(kind == "iban", _poured(value, stream, 2)).when(kind == "access_key", keys).otherwise(_poured(value, stream))

    return let(seed, lambda x: let(stream(x), made))


def surrogate(kind: Column, form: Column, entity: Column, draws: Column, secret: str) -> Column:
    """What stands in the place of an entity as it is written. form: its canonical form; draws: a map of the entities that
    drew again."""

    def made(value: Column) -> Column:
        before = F.substr(entity, F.lit(1), F.char_length(entity) - F.char_length(value))  # a secret's name, a person's title
        other = let(_draw(draws, kind, form), lambda n: _drawn(kind, form, value, n, secret))
        return F.concat(before, F.when(kind.isin(*PEOPLE), _name(kind, value, secret, draws)).when(kind == "ip", _address(value, secret)).when(kind.isin("card", "ssn", "phone"), _number_in_format(kind, value, secret)).otherwise(other))

    return let(value_of(kind, entity), made)


def _searched(text: Column, how) -> Column:  # noqa: ANN001
    """how(text, expression). Only a text with an @ is searched for addresses, which are the dearest to look for."""
    return F.when(text.contains("@"), how(text, F.lit(ANY))).otherwise(how(text, F.lit(WITHOUT_EMAIL)))


def found_in(text: Column) -> Column:
    """What the expressions find in a text, as it is written, in its order; null for null."""
    return _searched(text, lambda x, pattern: F.regexp_extract_all(x, pattern, F.lit(0)))


def _identity(x: Column) -> Column:
    return let(kind_of(x), lambda kind: F.struct(kind.alias("kind"), canonical(kind, x).alias("form")))


def _drawing(entities: DataFrame, *others: str) -> DataFrame:
    """kind and form of all that draws among entities (kind, form): names word by word."""
    people = F.col("kind").isin(*PEOPLE)
    words = entities.where(people).select(*others, F.lit("word").alias("kind"), F.explode(F.split("form", " ")).alias("form"))
    return entities.where(~people & ~F.col("kind").isin(*PERMUTED)).select(*others, "kind", "form").unionByName(words).distinct()


def redrawn(entities: DataFrame, secret: str) -> DataFrame:
    """kind, form and draw of those distinct entities (kind, form) that can't have their first surrogate.

    Of entities that meet, the least keeps its surrogate; a surrogate that is an entity of the same kind is kept by none.
    The space of draws grows from draw to draw, so the rounds grow as the logarithm of the entities.
    """
    kind, form, draw = F.col("kind"), F.col("form"), F.col("draw")
    taken = written(entities.select("kind", F.col("form").alias("made")), "entities")
    settled = None
    pending = entities.select("kind", "form", F.lit(0).alias("draw"))
    while True:
        made = F.when(kind == "word", _word(form, secret, draw)).otherwise(canonical(kind, _drawn(kind, form, form, draw, secret)))
        tried = written(pending.withColumn("made", made), "surrogates")
        won = tried.groupBy("kind", "made").agg(F.min(F.struct("form", "draw")).alias("w")).join(taken, ["kind", "made"], "left_anti")
        won = written(won.select("kind", "made", "w.form", "w.draw"), "kept")
        settled = won if settled is None else settled.unionByName(won)
        pending = written(tried.join(won, ["kind", "form"], "left_anti").select("kind", "form", (draw + 1).alias("draw")), "lost")
        if pending.isEmpty():
            return settled.where("draw > 0").select("kind", "form", "draw")
        taken = taken.unionByName(won.select("kind", "made"))


def pseudonymise(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with entities in their texts replaced, and a column `entities`: a map of type to the number replaced.

    A null text stays null and has no entities; a text without any is unchanged. Rows that repeat id and text come out
    alike. The same secret gives the same surrogates. There may be any number of entities. A column that is called
    `entities` is replaced. Names are found by a title before them; numbers that look like cards but have a wrong check sum
    are left.
    """
    names = [c for c in docs.columns if c != "entities"]
    key = lambda id_, text: F.struct(id_.alias("id"), F.unhex(F.md5(text)).alias("text")).alias("doc_")
    found = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), found_in(F.col(text_col)).alias("found_")).where(F.size("found_") > 0)
    keyed = found.select(key(F.col("id_"), F.col("text_")), F.array_distinct("found_").alias("found_"))
    held = written(keyed.select("doc_", F.explode("found_").alias("x")), "held-entities")
    known = held.select("x").distinct().select(_identity(F.col("x")).alias("who")).select("who.kind", "who.form").where("kind is not null").distinct()
    again = written(redrawn(written(_drawing(known), "drawing"), secret), "redrawn")

    own = docs.select(F.struct(*names).alias("row_"))
    text = F.col(f"row_.{text_col}")
    no_draws = F.lit(None).cast("map<string,int>")
    if again.isEmpty():
        own = own.withColumn("draws_", no_draws)
    else:
        who = held.select("doc_", _identity(F.col("x")).alias("who")).select("doc_", "who.kind", "who.form").where("kind is not null")
        draws = _drawing(who, "doc_").join(again, ["kind", "form"]).groupBy("doc_").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "form"), "draw"))).alias("draws_"))
        draws = written(draws, "draws")
        filter_bits = power_of_two(max(BITMAP_BITS, 32 * draws.count()))
        position = lambda x: F.pmod(F.xxhash64(x["id"], x["text"]), F.lit(filter_bits))
        filter_ = written(bitmaps(draws.select(position(F.col("doc_")).alias("at"))), "draws-filter")
        keyed = looked_up(own.withColumn("key_", key(F.col(f"row_.{id_col}"), text)), filter_, filter_bits, position(F.col("key_")), "maybe_")
        touched = keyed.where("maybe_").join(draws, F.col("key_").eqNullSafe(F.col("doc_")), "left").select("row_", "draws_")
        own = touched.unionByName(keyed.where("not maybe_").select("row_", no_draws.alias("draws_")))

    # Cut at the entities, a text has them at every second place. Where it holds the edge itself, it is searched twice.
    by_edges = F.split(_searched(text, lambda x, pattern: F.regexp_replace(x, pattern, F.lit(f"{EDGE}$0{EDGE}"))), EDGE, -1)
    cut = own.select("row_", "draws_", F.when(text.contains(EDGE), _by_search(text)).otherwise(by_edges).alias("parts_"))
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("form"))
    named = cut.select("row_", "draws_", "parts_", F.transform("parts_", lambda x, i: F.when(i % 2 == 1, _identity(x)).otherwise(none)).alias("who_"))
    stand_in = lambda x, who: F.when(who["kind"].isNull(), x).otherwise(surrogate(who["kind"], who["form"], x, F.col("draws_"), secret))
    kinds = F.filter(F.col("who_.kind"), lambda k: k.isNotNull())
    new = F.when(F.size(kinds) > 0, F.array_join(F.zip_with("parts_", "who_", stand_in), "")).otherwise(text)
    counted = let(kinds, lambda all_: F.map_from_arrays(F.array_distinct(all_), F.transform(F.array_distinct(all_), lambda k: F.size(F.filter(all_, lambda x: x == k)))))
    counted = F.coalesce(counted, F.create_map().cast("map<string,int>"))
    return named.select(*(new.alias(c) if c == text_col else F.col("row_")[c].alias(c) for c in names), counted.alias("entities"))


def _by_search(text: Column) -> Column:
    """The text cut at its entities, which are at every second place."""
    found = F.concat(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.array(F.lit("")))
    return F.flatten(F.zip_with(F.split(text, ANY, -1), found, lambda a, b: F.array(a, b)))
