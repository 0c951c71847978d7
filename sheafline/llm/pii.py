"""Surrogates for personal data, with DataFrame functions only.

One regular expression finds entities; each distinct value gets a keyed replacement of its own type: letters, digits and
punctuation stay what they are, card numbers keep their check digit valid, names keep gender, script and capitals. The
same value has the same surrogate everywhere. Surrogates are checked against each other and against all detected values:
the loser of a collision draws again, with a longer name or the next keyed draw, until all are distinct.

A person is found by a title. A title that tells no gender leaves it to how the given name stands elsewhere, and a full
name without a title is replaced where the same text has its given name and its surname with one.

Null texts stay null, empty ones empty; ties between colliding values go to the smaller value; repeated rows are
replaced alike; rows with a null id are told apart by their text; a text of any length is replaced whole; a value in very
many rows is met by join_hot; an empty table gives an empty result. Columns of the input pass through under their own
names, whatever these are: working columns clash with none. Each text is searched once, and only those with finds are
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tasks import discard, join_hot, plain_id, written

_IN, _OUT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
NEUTRAL = "Dr|Prof|Professor|Doctor"
MALE, FEMALE = "Mr|Herr|Monsieur|Señor|Господин", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Госпожа"
_KEY = r"""(?i:password|passwd|token|secret|api_?key)["']? {0,3}[=:] {0,3}["']?"""
#: Patterns by type, the first that matches a place counts.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}" + _OUT,
    "ipv6": r"(?<![\p{L}\p{N}_.:])" + rf"(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}}|{_HEX}:(?::{_HEX}){{2,6}}|(?=[A-Fa-f]*\d)[0-9A-Fa-f]{{4}}::{_HEX})" + r"(?![\p{L}\p{N}_:])(?!\.\d)",
    "ip": r"(?<![\p{L}\p{N}_.])" + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + r"(?![\p{L}\p{N}_])(?!\.\d)",
    "ssn": _IN + r"\d{3}-\d{2}-\d{4}" + r"(?![\p{L}\p{N}_-])",
    "phone": r"(?<![\p{L}\p{N}_+])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})" + r"(?![\p{L}\p{N}_])",
    "card": r"(?<![\p{L}\p{N}_.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})" + _OUT,
    "iban": _IN + r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)" + _OUT,
    "cloud_key": _IN + r"AKIA[0-9A-Z]{16}" + _OUT,
    "secret": _KEY + r"[A-Za-z0-9_+/.=-]{6,}",
    "person": _IN + rf"(?:{MALE}|{FEMALE}|{NEUTRAL})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+){{0,2}}" + _OUT,
}
# All types but secrets begin after no letter, digit or underscore: tested once a place, so that most places fail at once.
_BEGIN = _IN + r"(?=[\p{L}0-9._%+(-])"
#: Words among which two may be a full name.
NAMES = _IN + r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)+" + _OUT
MASTER = f"{_BEGIN}(?:" + "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "secret") + f")|(?=[PpTtSsAa]){PATTERNS['secret']}"

#: Syllables of invented names, by script.
STEMS = {
    "latin": ("Al", "Ber", "Cor", "Dan", "El", "Fer", "Gar", "Hol", "Jon", "Kar", "Lor", "Mar", "Nor", "Or", "Ral", "Ter"),
    "cyrillic": ("Ан", "Бор", "Вал", "Ген", "Дар", "Ев", "Зор", "Кир", "Лев", "Мар", "Ник", "Ол", "Рад", "Сев", "Тим", "Юл"),
}
MIDDLES = {"latin": ("a", "e", "i", "o", "ane", "eri", "ila", "omi"), "cyrillic": ("а", "е", "и", "о", "ане", "ери", "ила", "оми")}
ENDINGS = {
    ("given_m", "latin"): ("bert", "din", "gar", "mond", "nick", "rick", "ton", "win"),
    ("given_f", "latin"): ("bella", "dine", "gia", "lina", "nette", "rina", "tessa", "wyn"),
    ("surname", "latin"): ("berg", "den", "field", "ham", "ley", "mann", "son", "wood"),
    ("given_m", "cyrillic"): ("берт", "дим", "горь", "мир", "ник", "рик", "тон", "слав"),
    ("given_f", "cyrillic"): ("белла", "дина", "гина", "лина", "ника", "рина", "тина", "слава"),
    ("surname", "cyrillic"): ("бенко", "дец", "гайло", "хано", "лейко", "манко", "сенко", "вуд"),
}


def type_of(match: Column) -> Column:
    out = None
    for name, pattern in PATTERNS.items():
        if name == "secret":
            continue
        test = match.rlike(f"^(?:{pattern})$")
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("secret"))


def _piece(kind: Column, value: Column) -> Column:
    return F.struct(kind.cast("string").alias("kind"), value.alias("value"))


def _of_match(m: Column) -> Column:
    """A match as an array of (kind, value)."""
    keep = F.lit(None)
    words = F.split(m, " ")
    given = F.when(F.get(words, 0).rlike(rf"^(?:{FEMALE})\.?$"), F.lit("given_f")).when(F.get(words, 0).rlike(rf"^(?:{NEUTRAL})\.?$"), F.lit("given_n")).otherwise(F.lit("given_m"))
    named = F.flatten(F.transform(words, lambda w, i: F.array(_piece(keep, F.when(i == 0, "").otherwise(" ")), _piece(F.when(i == 0, keep).when(i == F.size(words) - 1, F.lit("surname")).otherwise(given), w))))
    kind = type_of(m)
    key = F.regexp_extract(m, f"^{_KEY}", 0)
    assigned = F.array(_piece(keep, key), _piece(F.lit("secret"), F.substr(m, F.length(key) + 1)))
    return F.when(kind == "person", named).when(kind == "secret", assigned).otherwise(F.array(_piece(kind, m)))


def _found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MASTER), F.lit(0))


def parts(text: Column, found: Column) -> Column:
    """The text as an array of (kind, value), given what _found has of it: kind is null for what stays."""
    between = F.split(text, MASTER, -1)
    entity = lambda m: F.get(F.transform(F.array(m), _of_match), 0)  # noqa: E731 - bound once, as its type takes many tests
    return F.flatten(F.transform(between, lambda b, i: F.concat(F.array(_piece(F.lit(None), b)), F.when(i < F.size(found), entity(F.get(found, i))).otherwise(F.expr("cast(array() as array<struct<kind:string,value:string>>)")))))


def _draws(key: str, length: Column) -> Column:
    """At least `length` keyed bytes as hexadecimal digits, 64 bytes a string, from kind, value and draw."""
    # a long value's digest stands for it, so that time follows its length and not the square
    value = F.when(length > 256, F.sha2(F.col("value"), 512)).otherwise(F.col("value"))
    seed = lambda v, b: F.sha2(F.concat_ws("\x01", F.lit(key), "kind", v, F.col("draw").cast("string"), b.cast("string")), 512)
    return F.get(F.transform(F.array(value), lambda v: F.transform(F.sequence(F.lit(0), F.floor(length / 64).cast("int")), lambda b: seed(v, b))), 0)


def _byte(hexes: Column, i: Column) -> Column:
    return F.conv(F.substr(F.get(hexes, F.floor(i / 64).cast("int")), i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _same_format(value: Column, hexes: Column) -> Column:
    """Each letter and digit replaced by one of its kind."""

    def one(c: Column, i: Column, hex_digits: Column) -> Column:
        b = _byte(hexes, i)
        letter = lambda first, n: F.substr(F.lit(first), b % n + 1, F.lit(1))
        lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return (
            F.when(hex_digits & (c != ":"), letter("0123456789abcdef", 16)).when(c.rlike("[0-9]"), F.when(i == 0, letter("123456789", 9)).otherwise(letter("0123456789", 10)))
            .when(c.rlike("[a-z]"), letter(lower, 26)).when(c.rlike("[A-Z]"), letter(upper, 26)).otherwise(c)
        )

    # bound once, not tested again at each character
    hexadecimal = (F.col("kind") == "secret") & value.rlike("^(?=.*[a-f])[0-9a-f]{16,}$") | (F.col("kind") == "ipv6")
    return F.get(F.transform(F.array(hexadecimal), lambda x: F.array_join(F.transform(F.split(value, ""), lambda c, i: one(c, i, x)), "")), 0)


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right but one doubled."""
    d = F.reverse(F.split(digits, ""))
    add = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(add, F.lit(0), lambda a, x: a + x)


def _card(value: Column, hexes: Column) -> Column:
    drawn = F.concat(F.substring(value, 1, 1), F.substr(_same_format(value, hexes), F.lit(2)))
    zero = F.concat(F.substr(drawn, F.lit(1), F.length(drawn) - 1), F.lit("0"))
    bare = lambda x: F.regexp_replace(x, "[^0-9]", "")
    check = ((10 - _luhn(bare(zero)) % 10) % 10).cast("string")
    return F.when(_luhn(bare(value)) % 10 == 0, F.concat(F.substr(zero, F.lit(1), F.length(zero) - 1), check)).otherwise(drawn)


def _rest_97(account: Column) -> Column:
    """An account number behind its country and check digits, modulo 97; letters count from 10."""
    bare = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10).otherwise(a * 100) % 97 + code(c)) % 97


def _iban(value: Column, hexes: Column) -> Column:
    """Country kept, digits and letters drawn; check digits are right where they were."""
    drawn = F.concat(F.substring(value, 1, 2), F.substr(_same_format(value, hexes), F.lit(3)))
    with_check = lambda d: F.concat(F.substring(d, 1, 2), F.lpad((98 - _rest_97(F.concat(F.substring(d, 1, 2), F.lit("00"), F.substr(d, F.lit(5))))).cast("string"), 2, "0"), F.substr(d, F.lit(5)))
    return F.when(_rest_97(value) == 1, F.get(F.transform(F.array(drawn), with_check), 0)).otherwise(drawn)


def _name(value: Column, hexes: Column) -> Column:
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), _byte(hexes, F.lit(i)) % len(xs))
    out = None
    for script in ("cyrillic", "latin"):
        middles = F.array(*map(F.lit, MIDDLES[script]))
        more = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.col("draw") / 2).cast("int")), lambda i: F.when(i == 0, "").otherwise(F.get(middles, _byte(hexes, 2 + i % 60) % len(MIDDLES[script])))), "")
        ending = F.when(F.col("kind") == "given_m", pick(ENDINGS["given_m", script], 1)).when(F.col("kind") == "given_f", pick(ENDINGS["given_f", script], 1)).otherwise(pick(ENDINGS["surname", script], 1))
        name = F.concat(pick(STEMS[script], 0), more, ending)
        out = F.when(value.rlike(r"\p{IsCyrillic}"), name) if out is None else out.otherwise(name)
    return F.when((value == F.upper(value)) & (F.length(value) > 1), F.upper(out)).otherwise(out)


def surrogate(key: str) -> Column:
    """The keyed replacement of column value of type kind at this draw."""
    value, hexes = F.col("value"), _draws(key, F.length("value"))
    # bound once by a lambda over an array of one
    same = lambda v: F.get(F.transform(F.array(hexes), lambda h: _same_format(v, h)), 0)
    host = F.concat(F.regexp_replace(same(value), r"\.[A-Za-z]+$", ""), F.lit(".example"))
    octets = F.array_join(F.transform(F.split(value, r"\."), lambda _, i: (_byte(hexes, i) % 254 + 1).cast("string")), ".")
    country = F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .(-])|)", 1)
    head = F.when(F.col("kind") == "phone", country).when(F.col("kind") == "cloud_key", F.lit("AKIA")).otherwise("")
    kept = F.concat(head, F.substr(same(value), F.length(head) + 1))
    return (
        F.when(F.col("kind") == "email", host).when(F.col("kind") == "ip", octets).when(F.col("kind") == "iban", F.get(F.transform(F.array(hexes), lambda h: _iban(value, h)), 0))
        .when(F.col("kind") == "card", F.get(F.transform(F.array(hexes), lambda h: _card(value, h)), 0))
        .when(F.col("kind").isin("given_m", "given_f", "surname"), F.get(F.transform(F.array(hexes), lambda h: _name(value, h)), 0)).otherwise(kept)
    )


def surrogates(entities: DataFrame, key: str, most_draws: int = 64) -> DataFrame:
    """kind, value, surrogate for distinct kinds and values, all distinct and none a detected value.

    A draw that still collides after most_draws gets its own digest appended, which no other value has.
    """
    open_ = written(entities.select("kind", "value").distinct().withColumn("draw", F.lit(0)), "entities")
    real = open_.select(F.col("value").alias("surrogate")).distinct()
    done = None
    for draw in range(most_draws + 1):
        drawn = open_.select("kind", "value", "draw").withColumn("surrogate", surrogate(key))
        if draw == most_draws:
            drawn = drawn.withColumn("surrogate", F.concat_ws("-", "surrogate", F.sha2(F.concat_ws("\x01", "kind", "value"), 256)))
        drawn = written(drawn, "drawn")
        first = drawn.groupBy("surrogate").agg(F.min(F.struct("value", "kind")).alias("first"))
        ok = drawn.join(first, "surrogate").filter((F.col("first.value") == F.col("value")) & (F.col("first.kind") == F.col("kind"))).drop("first")
        ok = ok.join(real, "surrogate", "left_anti")
        if done is not None:
            ok = ok.join(done.select("surrogate"), "surrogate", "left_anti")
        ok = written(ok.select("kind", "value", "surrogate"), "surrogates")
        done = ok if done is None else done.unionByName(ok)
        open_ = written(drawn.join(ok, ["kind", "value"], "left_anti").select("kind", "value", F.lit(draw + 1).alias("draw")), "entities")
        if open_.isEmpty():
            break
    return done


def _settled(every: DataFrame) -> DataFrame:
    """kind, value, own: the kind under which each value gets its surrogate. A given name without a gender has the one that it has elsewhere, else a male one."""
    kinds = every.select("kind", "value").distinct()
    gender = kinds.filter(F.col("kind").isin("given_m", "given_f")).groupBy("value").agg(F.min("kind").alias("gender"))
    open_ = kinds.filter("kind = 'given_n'").join(gender, "value", "left").select("kind", "value", F.coalesce("gender", F.lit("given_m")).alias("own"))
    return kinds.filter("kind <> 'given_n'").select("kind", "value", F.col("kind").alias("own")).unionByName(open_)


_SEP = "\x01"


def _renamed(text: Column, new: Column) -> Column:
    """Text between entities with the full names that the row's surrogates know."""
    key = lambda kind, w: F.try_element_at(new, F.concat(F.lit(kind + _SEP), w))

    def one(m: Column) -> Column:
        words = F.split(m, " ")
        given = lambda w: F.coalesce(key("given_m", w), key("given_f", w), key("given_n", w))

        def word(w: Column, i: Column) -> Column:
            before, behind = F.get(words, i - 1), F.get(words, i + 1)
            first, last = given(w).isNotNull() & key("surname", behind).isNotNull(), given(before).isNotNull() & key("surname", w).isNotNull()
            return F.when(first, given(w)).when(last, key("surname", w)).otherwise(w)

        return F.array_join(F.transform(words, word), " ")

    found, between = F.regexp_extract_all(text, F.lit(NAMES), F.lit(0)), F.split(text, NAMES, -1)
    return F.array_join(F.transform(F.arrays_zip(between, found), lambda z: F.concat(z["0"], F.coalesce(one(z["1"]), F.lit("")))), "")


@plain_id
def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text, and n_entities: the number of replaced values."""
    columns = [f"c{i}" for i in range(len(docs.columns))]  # names that clash with no working column
    own = dict(zip(docs.columns, columns, strict=True))
    the_id, text = F.col(own[id_col]), F.col(own[text_col])
    table = docs.toDF(*columns).withColumn("__lost", F.when(the_id.isNull(), F.sha2(text, 256)))  # rows without an id are told apart by their text
    table = written(table.withColumn("__found", _found(text)), "searched")
    has = F.coalesce(F.size("__found") > 0, F.lit(False))
    values = F.filter(F.flatten(F.transform("__found", _of_match)), lambda p: p["kind"].isNotNull())
    every = table.filter(has).select(the_id.alias("__doc"), "__lost", F.explode(F.array_distinct(values)).alias("p"))
    every = written(every.select("__doc", "__lost", "p.kind", "p.value"), "occurrences")
    kinds = written(_settled(every), "kinds")
    drawn = surrogates(kinds.select(F.col("own").alias("kind"), "value"), key)
    uses = every.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("uses"))
    entries = written(kinds.join(drawn.withColumnRenamed("kind", "own"), ["own", "value"]).select("kind", "value", "surrogate").join(uses, ["kind", "value"]), "entries")
    entry = F.struct(F.concat_ws(_SEP, "kind", "value").alias("k"), F.col("surrogate").alias("v"))
    by_doc = join_hot(every, entries, ["kind", "value"], "uses", every.count()).groupBy("__doc", "__lost").agg(F.map_from_entries(F.collect_set(entry)).alias("__new"))
    # a row without finds gets new names only where its id also stands in a row with persons; ids are compared without their texts
    bare, named = table.filter(~has), every.filter("kind = 'surname'").select("__doc")
    twins = written(bare.select(the_id.alias("__doc")).distinct().join(named, "__doc", "left_semi"), "twins")
    same_id = the_id == F.col("__doc")
    some = table.filter(has).unionAll(bare.join(twins, same_id, "left_semi"))
    joined = some.join(by_doc.withColumnRenamed("__lost", "__lost_too"), the_id.eqNullSafe(F.col("__doc")) & F.col("__lost").eqNullSafe(F.col("__lost_too")), "left")
    replaced = joined.withColumn("__parts", F.when(F.col("__new").isNotNull(), parts(text, F.col("__found")))).withColumn("__named", F.exists(F.map_keys("__new"), lambda k: k.startswith("surname" + _SEP)))
    plain = lambda v: F.when(F.col("__named") & v.rlike(NAMES), _renamed(v, F.col("__new"))).otherwise(v)
    put = F.transform("__parts", lambda p: F.when(p["kind"].isNull(), plain(p["value"])).otherwise(F.coalesce(F.try_element_at("__new", F.concat_ws(_SEP, p["kind"], p["value"])), p["value"])))
    count = F.when(F.col("__parts").isNull(), 0).otherwise(F.size(F.filter("__parts", lambda p: p["kind"].isNotNull()))).cast("long")
    new = F.when(F.col("__parts").isNull(), text).otherwise(F.array_join(put, ""))
    shown = lambda rows, t, n: rows.select(*[(t if c == text_col else F.col(own[c])).alias(c) for c in docs.columns], n.alias("n_entities"))
    out = shown(bare.join(twins, same_id, "left_anti"), text, F.lit(0).cast("long")).unionAll(shown(replaced, new, count))
    discard(kinds)
    return out


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key="surrogates-1")
