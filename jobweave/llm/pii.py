"""Surrogates for personal data: keyed, of the same kind and format, never colliding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.operators.scratch import Scratch

_MALE = "Mr|Herr|Señor|Sr|Monsieur|г-н|κ"
_FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Mme|Madame|г-жа|κα"
_ANY = "Dr|Prof"
_TITLE = rf"(?:{_MALE}|{_FEMALE}|{_ANY})\.? "
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_LABEL = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"

# kinds in the order they are tried at a place; what follows is matched whole
KINDS: dict[str, str] = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "key_block": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[\s\S]*?-----END [A-Z ]{0,30}PRIVATE KEY-----",
    "secret": rf"(?<![A-Za-z0-9]){_LABEL}[^\s\"',;]{{6,}}+"
    r"|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9_-]{20,}+"
    r"|\beyJ[\w-]{10,}+\.[\w-]{10,}+\.[\w-]{10,}+|\b[0-9a-f]{32,64}+\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "phone": r"(?<!\d)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<![\d(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    "national_id": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"(?<![\p{{L}}.-]){_TITLE}\p{{Lu}}[\p{{L}}'-]{{1,40}}(?: \p{{Lu}}[\p{{L}}'-]{{1,40}})?",
}
# nothing begins inside a word of letters: those places are passed over at once
_INSIDE = r"(?![A-Za-z](?<=[A-Za-z]{2})|[\u0370-\u04ff](?<=\p{L}{2}))"
PATTERN = f"{_INSIDE}(?:{'|'.join(f'(?:{p})' for p in KINDS.values())})"

# fixed values: syllables of made-up names by script, and endings by gender
_SYLLABLES = {
    "latin": ("ba ce di fo gu la me ni po ru sa te vi wo za bra cle dri flo gre kla pri sto tre".split(), "na", "ro", "el"),
    "cyrillic": ("ба ве ди го ку ла ме ни по ру са те ви зо жа бра кле дри гло тре кра при сто фе".split(), "на", "ров", "ель"),
    "greek": ("βα γε δι φο κυ λα με νι πο ρυ σα τε βι ζο θα βρα κλε δρι φλο γρε κρα πρι στο τρε".split(), "να", "ρος", "ελ"),
}


def _hex(seed: Column, i: int) -> Column:
    return F.sha2(F.concat(seed, F.lit(f"#{i}")), 256)


def _number(stream: Column, at: Column | int) -> Column:
    """Four hex digits of a stream as a number."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(stream, at * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _letters(value: Column, stream: Column, attempt: Column) -> Column:
    """Every letter or digit replaced by one of its class; the rest stays, unless the
    value has no letter or digit: then every mark is replaced by a mark.  Words of
    hexadecimal digits alone keep to those.  Later attempts add characters."""
    hexa, marks = value.rlike("^[0-9a-f]{32,}$"), ~value.rlike(r"[\p{L}\p{N}]")
    pick = lambda s, n: F.substring(F.lit(s), n % len(s) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i % 64)
        return (
            F.when(hexa, pick("0123456789abcdef", n))
            .when(c.rlike("[0-9]"), pick("0123456789", n))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", n))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
            .when(c.rlike(r"[\p{L}\p{M}&&\p{IsCyrillic}]"), F.when(c.rlike(r"\p{Lu}"), pick("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", n)).otherwise(pick("абвгдежзиклмнопрстуфхцчшэюя", n)))
            .when(c.rlike(r"[\p{L}\p{M}&&\p{IsGreek}]"), F.when(c.rlike(r"\p{Lu}"), pick("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", n)).otherwise(pick("αβγδεζηθικλμνξοπρστυφχψω", n)))
            .when(c.rlike(r"\p{IsHan}"), pick("人大中上下天木水火山石田日月心手口目耳足", n))
            .when(c.rlike(r"\p{Lu}"), pick("ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ", n))
            .when(c.rlike(r"[\p{L}\p{M}]"), pick("àáâãäåèéêëìíîïòóôõöùúûü", n))
            .when(c.rlike(r"\p{N}"), pick("0123456789", n))
            .when(marks & ~c.rlike(r"\s"), pick("!#$%&*+=?@^~_.", n))
            .otherwise(c)
        )

    more = F.when(hexa, "0").otherwise("a")  # a class to draw from
    longer = F.concat(value, F.repeat(more, F.greatest(attempt - 3, F.lit(0))))
    return F.array_join(F.transform(F.split(longer, ""), one), "")


def _more_digits(stream: Column, attempt: Column) -> Column:
    """Further digits from the fourth attempt on: the space never runs out."""
    n = F.greatest(attempt - 3, F.lit(0))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (_number(stream, (i + 31) % 64) % 10).cast("string")), "")).otherwise("")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    def step(a: Column, x: Column) -> Column:
        d = x.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.struct(((a["s"] + F.when(a["odd"], twice).otherwise(d)) % 10).alias("s"), (~a["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("s"), F.lit(False).alias("odd"))
    return F.aggregate(F.reverse(F.split(digits, "")), start, step)["s"]


def _card(norm: Column, stream: Column) -> Column:
    """Digits whose Luhn sum is that of the original: valid numbers stay valid."""
    made = F.concat(
        F.array_join(
            F.transform(F.split(norm.substr(F.lit(1), F.length(norm) - 1), ""),
                        lambda c, i: (_number(stream, i % 64) % 10).cast("string")), "",
        ),
        F.lit("0"),
    )
    last = (_luhn(norm) - _luhn(made) + 10) % 10
    return F.concat(made.substr(F.lit(1), F.length(norm) - 1), last.cast("string"))


def _phone(norm: Column, stream: Column) -> Column:
    """A country code stays; the next digit is 2 to 9."""
    code = F.when(norm.startswith("+"), F.regexp_extract(norm, r"^\+(?:1|7|\d{2})", 0)).otherwise(F.lit(""))
    rest = F.split(norm.substr(F.length(code) + 1, F.length(norm)), "")
    made = F.transform(
        rest, lambda c, i: F.when(i == 0, _number(stream, 0) % 8 + 2).otherwise(_number(stream, i % 64) % 10).cast("string")
    )
    return F.concat(code, F.array_join(made, ""))


def _ip(norm: Column, stream: Column, attempt: Column) -> Column:
    """Octets keep their number of digits; after many collisions only their range."""
    def octet(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        made = F.when(attempt > 8, n % 254 + 1).when(F.length(c) == 1, n % 9 + 1).when(
            F.length(c) == 2, n % 90 + 10
        ).otherwise(n % 155 + 100)
        return made.cast("string")

    return F.array_join(F.transform(F.split(norm, r"\."), octet), ".")


def _name(norm: Column, stream: Column, gender: Column, attempt: Column) -> Column:
    """Words of made-up syllables; each attempt adds one to the first word."""
    def made(script: str) -> Column:
        syllables, f, m, x = _SYLLABLES[script]
        table = F.array(*[F.lit(s) for s in syllables])
        end = F.when(gender == "f", f).when(gender == "m", m).otherwise(x)

        def word(w: Column, i: Column) -> Column:
            parts = [F.element_at(table, _number(stream, i * 8 + j) % len(syllables) + 1) for j in range(4)]
            more = F.when((i == 0) & (attempt > 0), F.array_join(F.transform(
                F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda j: F.element_at(table, _number(stream, (j + 39) % 64) % len(syllables) + 1)
            ), "")).otherwise("")
            return F.initcap(F.concat(*parts[:3], more, F.when(i == 0, end).otherwise(parts[3])))

        return F.array_join(F.transform(F.split(norm, " "), word), " ")

    return F.when(norm.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(norm.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def _kind(entity: Column) -> Column:
    out = None
    for kind, p in KINDS.items():
        if kind != "name":
            hit = entity.rlike(f"^(?:{p})$")
            out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("name")


def _parts(entity: Column, kind: Column) -> tuple[Column, Column]:
    """What of a mention stays in front, and the value that is replaced."""
    head = F.when(kind == "name", F.regexp_extract(entity, f"^{_TITLE}", 0)).when(
        kind == "secret", F.regexp_extract(entity, f"^{_LABEL}", 0)
    ).otherwise("")
    return head, entity.substr(F.length(head) + 1, F.length(entity))


def _norm(kind: Column, value: Column) -> Column:
    """Mentions that differ in spacing, marks or an e-mail's case are one entity."""
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "phone", F.regexp_replace(value, r"[^\d+]", ""))
        .when(kind.isin("card", "national_id"), F.regexp_replace(value, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .otherwise(value)
    )


def _gender(kind: Column, head: Column) -> Column:
    return F.when(
        kind == "name",
        F.when(head.rlike(rf"^(?:{_FEMALE})\.? $"), "f").when(head.rlike(rf"^(?:{_MALE})\.? $"), "m").otherwise("n"),
    ).otherwise("")


def _stream(key: str) -> Column:
    """Hex digits that depend on the key, the entity and the attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), "kind", "gender", "norm", F.col("attempt").cast("string"))
    return F.concat(*[_hex(seed, i) for i in range(4)])


def _surrogate() -> Column:
    stream, attempt = F.col("stream"), F.col("attempt")
    at = F.length(F.substring_index("norm", ".", -1)) + 1
    local = F.col("norm").substr(F.lit(1), F.length("norm") - at)
    email = F.concat(_letters(local, stream, attempt), F.lit("."), F.substring_index("norm", ".", -1))
    block = F.concat(
        F.regexp_extract("norm", r"^-----[^-]*-----", 0),
        _letters(F.regexp_extract("norm", r"^-----[^-]*-----([\s\S]*)-----END", 1), stream, attempt),
        F.regexp_extract("norm", r"-----END[^-]*-----$", 0),
    )
    iban = F.concat(F.col("norm").substr(1, 2), _letters(F.col("norm").substr(F.lit(3), F.length("norm")), stream, attempt))
    prefix = F.regexp_extract("norm", r"^(?:AKIA|gh[pousr]_|sk-|eyJ)", 0)
    secret = F.concat(prefix, _letters(F.col("norm").substr(F.length(prefix) + 1, F.length("norm")), stream, attempt))
    return (
        F.when(F.col("kind") == "email", email)
        .when(F.col("kind") == "key_block", block)
        .when(F.col("kind") == "secret", secret)
        .when(F.col("kind") == "iban", iban)
        .when(F.col("kind") == "ip", _ip(F.col("norm"), stream, attempt))
        .when(F.col("kind") == "phone", F.concat(_phone(F.col("norm"), stream), _more_digits(stream, attempt)))
        .when(F.col("kind") == "national_id", _letters(F.col("norm"), stream, attempt))
        .when(F.col("kind") == "card", _card(F.col("norm"), stream))
        .otherwise(_name(F.col("norm"), stream, F.col("gender"), attempt))
    )


def surrogate_table(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, gender, norm, surrogate) from distinct (kind, gender, norm).

    A surrogate is a function of the key, the entity and an attempt.  One that equals
    any entity of its kind in the corpus, or that another entity has, is refused: of
    rivals the smallest entity wins and the rest try again, until all are settled.
    So different entities never share a surrogate and none stands for itself.
    """
    real = entities.select(F.col("kind").alias("k"), F.col("norm").alias("v")).distinct()
    pending = entities.withColumn("attempt", F.lit(0))
    settled = None
    while True:
        # a column of its own: the digests are computed once an entity, not once a letter
        tried = pending.withColumn("stream", _stream(key)).withColumn("surrogate", _surrogate()).drop("stream")
        free = tried.join(
            real, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("v")), "left_anti"
        )
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min(F.struct("norm", "gender")).alias("w")).select(
            "kind", F.col("w.gender").alias("gender"), F.col("w.norm").alias("norm"), "surrogate"
        )
        won = scratch.keep(won, "surrogates")
        settled = won if settled is None else settled.unionByName(won)
        pending = pending.join(won, ["kind", "gender", "norm"], "left_anti").withColumn("attempt", F.col("attempt") + 1)
        pending = scratch.keep(pending, "rivals")
        if pending.isEmpty():
            return settled


def _laid_out(value: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own spacing and marks."""
    spaced = kind.isin("phone", "card", "national_id", "iban")
    # as many of the surrogate's characters are used up as the mention has so far
    chars = F.split(F.regexp_replace(surrogate, r"^\+", ""), "")
    body = F.regexp_replace(value, r"^\+", "")
    laid = F.aggregate(
        F.split(body, ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda a, c: F.when(
            c.rlike("[0-9A-Z]"),
            F.struct(F.concat(a["out"], F.get(chars, a["n"])).alias("out"), (a["n"] + 1).alias("n")),
        ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n"))),
        # what a later attempt has added follows
        lambda a: F.concat(a["out"], F.array_join(F.slice(chars, a["n"] + 1, F.size(chars)), "")),
    )
    return F.when(spaced, F.concat(F.when(value.startswith("+"), "+").otherwise(""), laid)).otherwise(surrogate)


def with_surrogates(docs: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, as (row, text, n_entities,
    kinds): ``row`` is the struct of the original columns.

    Found are the KINDS: e-mail addresses, key blocks, labelled or well-known secrets,
    bank accounts, internet addresses, phone numbers, national numbers, card numbers,
    and names behind a title.  Equal entities get equal surrogates in all documents,
    different ones different surrogates; names keep the title's gender, the script and
    the number of words, numbers their format and (cards) validity.

    Only rows with entities are shuffled; an entity that a third of them mention is
    one row of the table, and its join is an ordinary one that splits.  Null text
    stays null with 0 entities; repeated rows and null ids are rows like others; an
    empty table gives no rows.
    """
    text = F.coalesce("row.text", F.lit(""))
    # one search through every text; all later steps read what it found
    rows = scratch.keep(
        docs.select(F.struct("*").alias("row")).select(
            "row", F.monotonically_increasing_id().alias("id"),
            F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("entities"),
        ),
        "entities",
    )
    found = rows.filter(F.size("entities") > 0)
    kind = _kind(F.col("entity"))
    mentions = found.select("id", F.posexplode("entities").alias("pos", "entity")).withColumn("kind", kind)
    head, value = _parts(F.col("entity"), F.col("kind"))
    mentions = mentions.withColumns({"head": head, "value": value}).withColumns(
        {"norm": _norm(F.col("kind"), F.col("value")), "gender": _gender(F.col("kind"), F.col("head"))}
    )
    mentions = scratch.keep(mentions.drop("entity"), "mentions")
    table = surrogate_table(mentions.select("kind", "gender", "norm").distinct(), key, scratch)
    new = mentions.join(table, ["kind", "gender", "norm"]).select(
        "id", F.struct("pos", "kind", F.concat("head", _laid_out(F.col("value"), F.col("kind"), F.col("surrogate"))).alias("s")).alias("m")
    )
    new = new.groupBy("id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    gaps = F.split("row.text", PATTERN, -1)
    put = F.zip_with(gaps, "ms", lambda g, m: F.concat(g, F.coalesce(m["s"], F.lit(""))))
    changed = found.select("id", "row").join(new, "id").select(
        "row", F.array_join(put, "").alias("text"), F.size("ms").cast("long").alias("n_entities"),
        F.array_sort(F.array_distinct("ms.kind")).alias("kinds"),
    )
    same = rows.filter(F.size("entities") == 0).select(
        "row", F.col("row.text").alias("text"), F.lit(0).cast("long").alias("n_entities"),
        F.array().cast("array<string>").alias("kinds"),
    )
    return same.unionByName(changed)
