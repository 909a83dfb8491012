"""Personal data replaced by surrogates, in DataFrame expressions alone.

Entities are found by one pattern: mail and network addresses, phone, card and identity numbers,
keys, passwords, and names after a form of address, with every other mention of their parts in the
same document. Each is replaced by a surrogate of its kind,
drawn from a keyed hash of its normal form, so an entity has the same surrogate in every document
and every spelling, and nobody without the key can tell which. The surrogate keeps the format:
letters stay letters, digits digits, separators and case stay, card numbers pass their check, and
names keep gender (from the form of address) and script. The table of distinct entities is checked:
a surrogate that two entities share, or that is itself an entity of the corpus, is drawn again,
from a space that grows with the attempts where the format allows it. Numbers of fixed length have
no such space: if nearly all of them are entities, a surrogate may after ``NOT_REAL`` attempts be
another entity, and after ``SHARED`` one may serve two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.rows import packed, unpacked
from statloom.operators.stage import Stage

# Forms of address by gender, and what surrogate names are made of by script.
_MEN = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин"]
_WOMEN = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "госпожа"]
_SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "ga", "ha", "jo", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "na", "ne", "no", "ra", "re", "ri", "ro", "sa", "se", "ta", "te", "ti", "va"],
    "cyrillic": ["ба", "бе", "во", "га", "да", "де", "жа", "за", "ка", "ко", "ла", "ле", "ли", "ло", "ма", "ме", "ми", "на", "не", "но", "па", "ра", "ре", "ри", "ро", "са", "се", "та", "те", "ти", "фа", "ша"],
}
_ENDINGS = {("latin", "given_m"): "n", ("latin", "given_f"): "na", ("latin", "surname"): "ker", ("cyrillic", "given_m"): "н", ("cyrillic", "given_f"): "на", ("cyrillic", "surname"): "ко"}

_ADDRESS = "|".join(_MEN + _WOMEN)
_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:[-'’]?\p{Lu}\p{Ll}+)*"
#: A word that may be a later mention of a found name.
_MENTION = rf"(?<!\p{{L}}){_NAME}(?!\p{{L}})"
#: What each kind looks like; the first that fits a find names its kind.
KINDS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|akia)[A-Za-z0-9]{16}(?![A-Za-z0-9])",
    "hex_key": r"(?<![A-Za-z0-9])(?=[A-Fa-f]{0,63}[0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])",
    "password": r"(?i:(?<=password=)|(?<=passwd=)|(?<=pwd=)|(?<=secret=)|(?<=api_key=))[^\s\"'<>]{4,64}",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])",
    "card": r"(?<![0-9A-Za-z.-])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}])(?:{_ADDRESS})\.? {_NAME}(?: {_NAME})?",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
_DIGITS = ("phone", "ssn", "card")
#: Attempts from which a surrogate grows, may be another entity, and may be shared.
GROWS, NOT_REAL, SHARED = 3, 16, 32
_NAMES = ("given_f", "given_m", "surname")
#: Without one of these, no kind can be in a text; cheaper to look for than the pattern.
_HINT = rf"[0-9@=]|(?:{_ADDRESS})\.? \p{{Lu}}"


def kind_of(found: Column) -> Column:
    """The kind of a find, from its own characters (a password's context is not part of it)."""
    tests = [F.when(found.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in KINDS.items() if k != "password"]
    return F.coalesce(*tests, F.lit("password"))


def _normal(kind: Column, raw: Column) -> Column:
    """What spellings of one entity have in common."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    phone = F.when(F.length(digits) > 10, F.substring(digits, F.length(digits) - 9, F.lit(10))).otherwise(digits)
    return (
        F.when(kind == "phone", phone).when(kind.isin("ssn", "card"), digits)
        .when(kind.isin("email", "hex_key"), F.lower(raw)).when(kind == "iban", F.replace(raw, F.lit(" "), F.lit(""))).otherwise(raw)
    )


def _number(stream: Column, i: Column) -> Column:
    """The i-th of 64 numbers below 65,536 in a stream of hexadecimal digits."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _alike(text: Column, stream: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """The text with every letter and digit replaced by one of its class."""
    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        return F.when(c.rlike("[a-z]"), _pick(letters, n)).when(c.rlike("[A-Z]"), _pick(letters.upper(), n)).when(c.rlike("[0-9]"), _pick("0123456789", n)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _check_digit(digits: Column) -> Column:
    """The digit that makes a card number pass the sum check."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda t, i: t + F.when(value(i) > 9, value(i) - 9).otherwise(value(i)))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _iban_digits(country: Column, account: Column) -> Column:
    """The two digits that make an account number pass its check (remainder by 97)."""
    chars = F.split(F.concat(account, country, F.lit("00")), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(chars, F.lit(0), lambda r, c: F.pmod(r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _parts(found: Column) -> Column:
    """A find as parts with a kind each; only names have several, literal ones between.

    Card numbers that fail their check and addresses with a number above 255 are literal too.
    """
    kind = kind_of(found)
    digits = F.regexp_replace(found, "[^0-9]", "")
    valid = _check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, F.length(digits), F.lit(1))
    large = F.exists(F.split(found, r"\."), lambda x: x.cast("int") > 255)
    kind = F.when((kind == "card") & ~valid, "literal").when((kind == "ipv4") & large, "literal").otherwise(kind)
    given = F.when(F.substring_index(F.regexp_replace(found, r"\. ", " "), " ", 1).isin(_WOMEN), "given_f").otherwise("given_m")
    words = F.split(found, " ")
    one = lambda k, v: F.struct(k.alias("kind"), v.alias("raw"))
    literal = F.lit("literal")
    head = one(literal, F.concat(words[0], F.lit(" ")))
    name = F.when(F.size(words) > 2, F.array(head, one(given, F.get(words, F.lit(1))), one(literal, F.lit(" ")), one(F.lit("surname"), F.get(words, F.lit(2))))).otherwise(
        F.array(head, one(F.lit("surname"), F.get(words, F.lit(1))))
    )
    return F.when(kind == "name", name).otherwise(F.array(one(kind, found)))


def _drawn(kind: Column, normal: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a normal form at a given attempt."""
    seed = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), normal)
    stream = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256), F.lit("0000"))
    at = lambda i: _number(stream, F.lit(i))
    digits = _alike(normal, stream)
    long = F.substring(normal, F.lit(1), F.lit(1))
    body = F.concat(long, F.substring(digits, F.lit(2), F.length(digits) - 2))
    phone = F.concat((F.pmod(at(0), F.lit(8)) + 2).cast("string"), F.substring(digits, F.lit(2), F.length(digits)))
    octets = F.split(normal, r"\.")
    local = F.when(octets[0].isin("10", "127"), octets[0]).when(F.startswith(normal, F.lit("192.168.")), F.lit("192"))
    second = F.when(F.startswith(normal, F.lit("192.168.")), F.lit("168")).otherwise(F.pmod(at(2), F.lit(254)).cast("string"))
    ip = F.concat_ws(".", F.coalesce(local, (F.pmod(at(1), F.lit(110)) + 12).cast("string")), second, F.pmod(at(3), F.lit(254)).cast("string"), (F.pmod(at(4), F.lit(253)) + 1).cast("string"))
    # A domain has one surrogate whoever writes from it; its last label stays.
    user, domain = F.substring_index(normal, "@", 1), F.substring_index(normal, "@", -1)
    labels, top = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.substring_index(domain, ".", -1)
    domain_seed = F.concat_ws("|", F.lit(key), F.lit("domain"), domain)
    # Later attempts add letters; signs alone, as of a mask, give letters from the first on.
    more = F.transform(F.sequence(F.lit(1), F.greatest(attempt - GROWS, F.lit(1))), lambda i: _pick("abcdefghijklmnopqrstuvwxyz", _number(stream, i + 40)))
    more = F.when(attempt > GROWS, F.array_join(more, "")).otherwise("")
    signs = F.array_join(F.transform(F.split(normal, ""), lambda c, i: _pick("abcdefghijklmnopqrstuvwxyz", _number(stream, i))), "")
    free = F.concat(F.when(normal.rlike("[A-Za-z0-9]"), _alike(normal, stream)).otherwise(signs), more)
    country, account = F.substring(normal, 1, 2), _alike(F.substring(normal, F.lit(5), F.length(normal)), stream)
    email = F.concat(_alike(user, stream), more, F.lit("@"), _alike(labels, F.concat(F.sha2(domain_seed, 512), F.lit("0000"))), F.lit("."), top)
    cyrillic = normal.rlike(r"\p{IsCyrillic}")

    def name(script: str) -> Column:
        syllables = F.lit(_SYLLABLES[script])
        some = F.transform(F.sequence(F.lit(0), F.least(attempt, F.lit(20)) + 1), lambda i: F.element_at(syllables, F.pmod(_number(stream, i), F.lit(32)) + 1))
        end = F.coalesce(*[F.when(kind == k, F.lit(e)) for (s, k), e in _ENDINGS.items() if s == script])
        return F.initcap(F.concat(F.array_join(some, ""), end))

    return (
        F.when(kind == "card", F.concat(body, _check_digit(body))).when(kind == "phone", phone).when(kind == "ssn", digits)
        .when(kind == "ipv4", ip).when(kind == "email", email).when(kind == "hex_key", _alike(normal, stream, "abcdef"))
        .when(kind == "aws_key", F.concat(F.substring(normal, 1, 4), _alike(F.substring(normal, F.lit(5), F.lit(16)), stream)))
        .when(kind == "iban", F.concat(country, _iban_digits(country, account), account))
        .when(kind.isin("given_m", "given_f", "surname"), F.when(cyrillic, name("cyrillic")).otherwise(name("latin")))
        .otherwise(free)
    )


def _formatted(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the spelling of one find."""
    own = F.regexp_replace(raw, "[^0-9]", "")
    digits = F.concat(F.substring(own, F.lit(1), F.length(own) - F.length(surrogate)), surrogate)
    gaps = F.split(raw, "[0-9]", -1)
    numbers = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.when(i < F.length(digits), F.substring(digits, i + 1, F.lit(1))).otherwise(""))), "")
    spaced = F.split(raw, "[A-Z0-9]", -1)
    iban = F.array_join(F.transform(spaced, lambda g, i: F.concat(g, F.when(i < F.length(surrogate), F.substring(surrogate, i + 1, F.lit(1))).otherwise(""))), "")
    shout = (raw == F.upper(raw)) & (raw != F.lower(raw))
    return (
        F.when(kind.isin(*_DIGITS), numbers).when(kind == "iban", iban)
        .when(kind.isin("email", "hex_key") & shout, F.upper(surrogate)).otherwise(surrogate)
    )


def surrogates(entities: DataFrame, key: str, stage: Stage) -> DataFrame:
    """``(kind, normal, surrogate)`` of distinct entities: one each, none shared, none itself an entity.

    Formats too narrow for that end as the module says. Drawing is spread over tasks by entity.
    """
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entities = entities.select("kind", "normal").distinct().withColumn("attempt", F.lit(0))
    entities = stage.put(entities.repartition(tasks, "kind", "normal"), "entities")
    real = entities.select("kind", F.col("normal").alias("surrogate"), F.lit(True).alias("real"))
    # Few bytes but much work: rows must not be gathered by size, so they are dealt by number.
    table = entities.repartition(tasks, "kind", "normal").withColumn("surrogate", _drawn(F.col("kind"), F.col("normal"), key, F.col("attempt")))
    turn = 0
    while True:
        table = stage.put(table, f"surrogates-{turn}")
        first = table.groupBy("kind", "surrogate").agg(F.min("normal").alias("owner"), F.count(F.lit(1)).alias("n"))
        taken = first.join(real, ["kind", "surrogate"], "left").withColumn("real", F.col("real") & F.lit(turn < NOT_REAL))
        taken = taken.filter(F.col("real") | ((F.col("n") > 1) & F.lit(turn < SHARED)))
        taken = stage.put(taken.select("kind", "surrogate", "owner", F.coalesce("real", F.lit(False)).alias("real")), f"taken-{turn}")
        if taken.isEmpty():
            return table.select("kind", "normal", "surrogate")
        # Of those that share a surrogate the smallest keeps it, unless it is an entity.
        again = table.join(taken, ["kind", "surrogate"], "left")
        lost = F.col("owner").isNotNull() & (F.col("real") | (F.col("owner") != F.col("normal")))
        attempt = (F.col("attempt") + F.when(lost, 1).otherwise(0)).alias("attempt")
        drawn = F.when(F.col("lost"), _drawn(F.col("kind"), F.col("normal"), key, F.col("attempt"))).otherwise(F.col("surrogate"))
        table = again.select("kind", "normal", attempt, "surrogate", F.coalesce(lost, F.lit(False)).alias("lost")).repartition(tasks, "kind", "normal")
        table = table.select("kind", "normal", "attempt", drawn.alias("surrogate"))
        turn += 1


def _mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``(key, gaps, more)``: what lies between the finds of a text, untitled names replaced.

    ``names`` gives the ``new`` form of each ``word`` that is part of a name found in the text.
    """
    gaps = texts.select("key", F.posexplode(F.split("text", PATTERN, -1)).alias("pos", "gap"))
    words = gaps.select("key", "pos", F.posexplode(F.regexp_extract_all("gap", F.lit(_MENTION), 0)).alias("i", "word"))
    words = words.join(names, ["key", "word"], "left").withColumn("made", F.coalesce("new", "word"))
    filled = words.groupBy("key", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "made"))), lambda x: x["made"]).alias("made"), F.count("new").alias("more"))
    between = F.split("gap", _MENTION, -1)
    joined = F.array_join(F.transform(between, lambda g, i: F.concat(g, F.coalesce(F.get("made", i), F.lit("")))), "")
    gaps = gaps.join(filled, ["key", "pos"], "left").select("key", "pos", joined.alias("gap"), F.coalesce("more", F.lit(0)).alias("more"))
    return gaps.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "gap"))), lambda x: x["gap"]).alias("gaps"), F.sum("more").alias("more"))


def replace_entities(df: DataFrame, key: str, text: str = "text", count: str = "n_entities") -> DataFrame:
    """All rows and columns, entities in ``text`` replaced, with their number in ``count``.

    Words of a text that equal a given name or surname found in it are replaced alike; one that is
    both counts as a given name. Texts without an entity stay as they are, null stays null (with 0 entities). ``key`` is the
    secret behind the surrogates. Equal texts get equal results; repeated rows stay; a column
    named like ``count`` is replaced; an empty table stays empty.
    """
    stage = Stage(df.sparkSession, "pii")
    rows = packed(df, text=F.col(text))
    has = F.coalesce(F.col("text").rlike(_HINT) & F.col("text").rlike(PATTERN), F.lit(False))
    hits = stage.put(rows.filter(has).withColumn("key", F.md5("text")), "hits")
    found = hits.select("key", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found")).dropDuplicates(["key"])
    parts = found.select("key", F.posexplode("found").alias("pos", "entity")).select("key", "pos", F.posexplode(_parts(F.col("entity"))).alias("sub", "part"))
    parts = parts.select("key", "pos", "sub", "part.kind", "part.raw").withColumn("normal", _normal(F.col("kind"), F.col("raw")))
    parts = stage.put(parts, "parts")
    table = surrogates(parts.filter("kind <> 'literal'"), key, stage)
    made = parts.join(table, ["kind", "normal"], "left")
    made = made.withColumn("new", F.when(F.col("kind") == "literal", F.col("raw")).otherwise(_formatted(F.col("kind"), F.col("raw"), F.col("surrogate"))))
    # What one text holds, in order; as long as the text at most.
    whole = made.groupBy("key", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", "new"))), lambda x: x["new"]), "").alias("new"), F.max((F.col("kind") != "literal").cast("long")).alias("n"))
    whole = whole.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("news"), F.sum("n").alias("n"))
    gaps, more = F.split("text", PATTERN, -1), F.lit(0)
    named = made.filter(F.col("kind").isin(*_NAMES))
    if not parts.filter(F.col("kind").isin(*_NAMES)).isEmpty():
        names = stage.put(named.groupBy("key", F.col("raw").alias("word")).agg(F.min(F.struct("kind", "new"))["new"].alias("new")), "names")
        texts = hits.join(names.select("key").distinct(), "key", "left_semi").select("key", "text").dropDuplicates(["key"])
        whole = whole.join(_mentions(texts, names), "key", "left")
        gaps, more = F.coalesce("gaps", gaps), F.coalesce("more", F.lit(0))
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("news", i), F.lit("")))), "")
    changed = hits.join(whole, "key").select("row", joined.alias("text"), (F.col("n") + more).alias("n"))
    same = rows.filter(~has).select("row", "text", F.lit(0).cast("long").alias("n"))
    # Columns keep their places: the text is replaced, the count comes last.
    out = changed.unionByName(same)
    kept = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns if c != count]
    return out.select(*kept, F.col("n").alias(count))
