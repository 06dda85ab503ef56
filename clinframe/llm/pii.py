"""Replace personal data by keyed surrogates of the same type and format.

Detected entities are reduced to a canonical form (digits of a number, lower case of an address or
a name), so every spelling of an entity gets the same surrogate in all documents, dressed in the
format of each occurrence: separators, letter case, and for names the script and, after a title,
the gender. A name is found behind a title; its other mentions in the same text are replaced with
it. Candidates come from a keyed hash. All distinct entities of the corpus are then checked
together: a candidate that equals a real entity, a surrogate in use, or another entity's candidate
is drawn again, so distinct entities stay distinct.

Everything is DataFrame functions. Documents without entities are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinframe.llm.common import any_of, apart
from clinframe.session import stored

#: Titles by gender (m, f, or u for either). Fixed values.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sir", "MR", "HERR", "господин", "Господин", "κύριος", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "MRS", "MS", "FRAU", "MME", "госпожа", "Госпожа", "κυρία", "Κυρία"),
    "u": ("Dr", "Prof", "Mx", "DR"),
}
#: Given names by script and gender. Fixed values.
GIVEN = {
    "latin_m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Max Noah Oscar Paul Quentin Rafael Simon Thomas Victor Walter".split(),
    "latin_f": "Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Klara Laura Maria Nina Olga Paula Rosa Sofia Teresa Ursula Vera Wilma".split(),
    "latin_u": "Alex Robin Kim Charlie Sam Jamie Taylor Jordan Morgan Casey Riley Quinn Avery Rowan Sasha Noa Andrea Dominique Camille Maxime".split(),
    "cyrillic_m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Сергей Тимур Фёдор Юрий".split(),
    "cyrillic_f": "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса София Тамара Юлия".split(),
    "greek_m": "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θανάσης Κώστας Λεωνίδας Μιχάλης Νίκος Παύλος Σπύρος".split(),
    "greek_f": "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
}
#: Syllables and name endings by script, for names beyond the lists. Fixed values.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ja ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa za".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то".split(),
    "greek": "βα γα δα κα κο λα λο μα μο να νο πα πο ρα ρο σα σο τα το φα".split(),
}
ENDINGS = {
    "latin_m": "rt", "latin_f": "na", "latin_u": "n", "latin": "mann",
    "cyrillic_m": "слав", "cyrillic_f": "ина", "cyrillic_u": "ша", "cyrillic": "ко",
    "greek_m": "ος", "greek_f": "ία", "greek_u": "ι", "greek": "ίδης",
}
#: Rounds of drawing after which a mailbox or a secret gets one character more, as its format has
#: hardly a free place left; numbers and addresses have over 10^9, and keep their format.
WIDEN = 6

_TITLE = any_of(t for own in TITLES.values() for t in own) + r"\.?"
_WORD = r"\p{Lu}[\p{L}'’\-]{1,29}"
# A name does not end with a genitive's mark or a dash.
_WHOLE = _WORD + r"(?<!['’][sS])(?<!['’\-])"
# White space between a title and the words of a name.
_GAP = r"\s{1,4}"
# What a secret stands behind; a password may be short.
_PASS, _KEYED, _SIGN = r"(?i:password|passwd)", r"(?i:token|secret|password|passwd|key)", r"\s{0,2}[=:]\s{0,2}"
_END = r"[^\s\"'<>.,;:!?)\]}]"
# What a match must begin with, or stand behind, is asked first: looking further back is costly.
_NAME = rf"(?=\p{{Lu}})(?<=\s)(?:{'|'.join(rf'(?<=(?<!\p{{L}}){_TITLE}{_GAP}{words}){_WHOLE}' for words in ('', _WORD + _GAP, _WORD + _GAP + _WORD + _GAP))})"
#: Patterns in the order in which they are tried; numbers are told apart afterwards.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+",
    # Behind a colon, words that only look like a value are common after "key", "token" and "secret".
    # What holds no letter and no digit, such as ****, hides a secret already.
    "secret": rf"(?<=[\"'=:\s])(?=[^\"'\s<>]*[\p{{L}}\p{{N}}])(?:(?<=[\"'])(?:(?<={_KEYED}{_SIGN}[\"'])[^\"'\s]{{8,}}|(?<={_PASS}{_SIGN}[\"'])[^\"'\s]{{4,}})(?=[\"'])"
    rf"|(?<=[=:]\s{{0,2}})(?:(?<={_PASS}{_SIGN})[^\s\"'<>]{{3,}}{_END}"
    rf"|(?<={_KEYED}\s{{0,2}}=\s{{0,2}})[^\s\"'<>]{{7,}}{_END}|(?<={_KEYED}{_SIGN})(?=[^\s\"'<>]*\d)[^\s\"'<>]{{7,}}{_END}))",
    "iban": r"(?=[A-Z]{2}\d{2})(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "number": r"(?=[\d+(])(?:"
    r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
    r"|(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
    r"|(?<![\d.])(?:\d{4}[ \-]){3}\d{4}(?!\d)|(?<![\d.])\d{13,19}(?!\d)"
    r"|(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .\-]?\(\d{1,4}\)|[ .\-]?\d{2,4})(?:[ .\-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<![\p{L}\p{N}.\-])(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d))",
    "name": _NAME,
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must hold for any pattern to match.
_TITLED = rf"(?<!\p{{L}}){_TITLE}\s"
_HINT = rf"[0-9@]|{_KEYED}\s{{0,2}}[=:]|{_TITLED}"

_DIGIT = r"^\d$"
_HEX = "^[0-9A-Fa-f]+$"


def _kind(found: Column) -> Column:
    """Type of a match, from its own characters."""
    digits = F.length(F.regexp_replace(found, r"\D", ""))
    out = F.when(found.rlike("^[^@]+@[^@]+[.][^@]+$"), "email")
    out = out.when(found.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip")
    out = out.when(found.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
    out = out.when(found.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$") & (digits >= 2), "iban")
    out = out.when(found.rlike(r"^[\d \-]+$") & (digits >= 13), "card")
    out = out.when(found.rlike(r"^[+(\d][\d ().\-]+$"), "phone")
    return out.when(found.rlike(rf"^{_WORD}$"), "name").otherwise("secret")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(before: Column) -> Column:
    ends = lambda own: before.rlike(rf"(?<!\p{{L}})(?:{'|'.join(own)})\.?{_GAP}$")
    return F.when(ends(TITLES["m"]), "m").when(ends(TITLES["f"]), "f").otherwise("u")


def _canon(kind: Column, found: Column) -> Column:
    number = kind.isin("phone", "card", "ssn")
    out = F.when(number, F.regexp_replace(found, r"\D", "")).when(kind == "iban", F.regexp_replace(found, " ", ""))
    out = out.when((kind == "secret") & ~found.rlike(_HEX), found)
    return out.when(kind == "ip", found).otherwise(F.lower(found))


def _pick(choices: list[str], draw: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(draw, F.lit(len(choices))) + 1).cast("int"))


def _scramble(text: Column, seed: Column, hexadecimal: Column | None = None) -> Column:
    """Other characters of the same class, from draws of ``seed``; marks stay."""

    def one(c: Column, i: Column) -> Column:
        draw = F.xxhash64(seed, i)
        letters = "abcdefghijklmnopqrstuvwxyz"
        small = _pick(list(letters), draw)
        if hexadecimal is not None:
            small = F.when(hexadecimal, _pick(list("abcdef"), draw)).otherwise(small)
        out = F.when(c.rlike(_DIGIT), F.pmod(draw, F.lit(10)).cast("string"))
        out = out.when(c.rlike("[a-z]"), small).when(c.rlike("[A-Z]"), F.upper(small))
        for pattern, own in ((r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфх"), (r"\p{IsGreek}", "αβγδεζηθικλμνοπρσταυφ")):
            out = out.when(c.rlike(pattern), _pick(list(own), draw))
        return out.when(c.rlike(r"\p{L}"), small).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of a number's digits by the rule of payment cards."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, x: a + x)


def _syllable(syllables: list[str], seed: Column):
    return lambda i: _pick(syllables, F.xxhash64(seed, i))


def _name(kind: Column, canon: Column, seed: Column, attempt: Column) -> Column:
    """A name of the list, or one built of syllables from the second draw on. kind is
    given_<script>_<gender> or surname_<script>."""
    out = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        count = F.least(F.lit(12), F.lit(2) + F.floor(attempt / 2)).cast("int")
        built = F.array_join(F.transform(F.sequence(F.lit(1), count), _syllable(syllables, seed)), "")
        for end in ("m", "f", "u"):
            names = GIVEN.get(f"{script}_{end}") or GIVEN[f"{script}_m"] + GIVEN[f"{script}_f"]
            listed = F.lower(_pick(names, F.xxhash64(seed)))
            own = F.when(attempt == 0, listed).otherwise(F.concat(built, F.lit(ENDINGS[f"{script}_{end}"])))
            out = F.when(kind == f"given_{script}_{end}", own).otherwise(out)
        out = F.when(kind == f"surname_{script}", F.concat(built, F.lit(ENDINGS[script]))).otherwise(out)
    return out


def _candidate(key: str, attempt: Column) -> Column:
    """A surrogate in canonical form for (kind, canon)."""
    kind, canon = F.col("kind"), F.col("canon")
    seed = F.sha2(F.concat_ws("\n", F.lit(key), kind, canon, attempt.cast("string")), 256)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    # People of one domain stay together.
    host = _scramble(host, F.sha2(F.concat_ws("\n", F.lit(key), F.lit("domain"), domain), 256))
    more = F.floor(attempt / WIDEN).cast("int")
    hexadecimal = canon.rlike("^[0-9a-f]+$")
    like = F.when(canon.rlike("^[0-9]+$"), "0").otherwise("a")
    tail = _scramble(F.repeat(like, more), F.sha2(seed.cast("binary"), 256), hexadecimal)
    email = F.concat(_scramble(local, seed), tail, F.lit("@"), host, top)
    octet = lambda i: (F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(223)) + 1).cast("string")
    numbers = _scramble(canon, seed)
    first = F.substring(canon, 1, 1)
    most = F.length(canon) - 1
    # Cards keep their first digit, and stay valid or invalid by their check digit.
    body = F.concat(first, F.substring(numbers, F.lit(2), most - 1))
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    check = F.when(_luhn(canon) % 10 == 0, check).otherwise((check + 1 + F.pmod(F.xxhash64(seed), F.lit(9))) % 10)
    out = F.when(kind == "email", email).when(kind == "ip", F.concat_ws(".", *[octet(i) for i in range(4)]))
    out = out.when(kind == "card", F.concat(body, check.cast("int").cast("string")))
    out = out.when((kind == "phone") & (F.length(canon) > 10), F.concat(first, F.substring(numbers, F.lit(2), most)))
    out = out.when(kind == "iban", F.concat(F.substring(canon, 1, 2), F.substring(numbers, F.lit(3), most)))
    out = out.when(kind == "secret", F.concat(_scramble(canon, seed, hexadecimal), tail))
    return out.when(kind.isin("phone", "ssn"), numbers).otherwise(_name(kind, canon, seed, attempt))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """A surrogate for each distinct (kind, canon): different from all real entities and all other
    surrogates of its kind. Rounds go on until every entity has one; each leaves the share of the
    format's places that is taken."""
    open_, found, attempt = stored(entities), None, 0
    real = open_.select("kind", F.col("canon").alias("drawn"))
    while not open_.isEmpty():
        drawn = open_.withColumn("drawn", _candidate(key, F.lit(attempt)))
        # Of entities that drew the same, one may keep it.
        kept = drawn.groupBy("kind", "drawn").agg(F.min("canon").alias("canon"))
        kept = kept.join(real, ["kind", "drawn"], "left_anti")
        if found is not None:
            kept = kept.join(found.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        kept = stored(kept.select("kind", "canon", "drawn"))
        open_ = stored(open_.join(kept, ["kind", "canon"], "left_anti"))
        found = kept if found is None else found.unionByName(kept)
        attempt += 1
    if found is None:
        return open_.withColumn("drawn", F.lit(None).cast("string"))
    return found


def _dressed(kind: Column, found: Column, drawn: Column) -> Column:
    """A surrogate in the format of an occurrence."""
    chars = F.filter(F.split(found, ""), lambda c: c != "")

    def filled(pattern: str) -> Column:
        """Characters that match are replaced in turn by those of the surrogate."""

        def one(c: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x.rlike(pattern)))
            return F.when(c.rlike(pattern), F.substring(drawn, before, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(chars, one), "")

    def cased(c: Column, i: Column) -> Column:
        own = F.substring(drawn, i + 1, F.lit(1))
        return F.when(c.rlike(r"\p{Lu}"), F.upper(own)).otherwise(own)

    # A surrogate that had to grow has characters beyond those of the occurrence.
    beyond = F.substring(drawn, F.length(found) + 1, F.length(drawn))
    upper = F.when((F.upper(found) == found) & (F.length(found) > 1), F.upper(drawn)).otherwise(F.initcap(drawn))
    out = F.when(kind.isin("phone", "card", "ssn"), filled(r"^\d$")).when(kind == "iban", filled("^[A-Z0-9]$"))
    out = out.when(kind == "email", F.concat(F.array_join(F.transform(chars, cased), ""), beyond))
    out = out.when((kind == "secret") & found.rlike("^[0-9A-F]*[A-F][0-9A-F]*$"), F.upper(drawn))
    out = out.when((kind == "secret") & found.rlike(_HEX) & found.rlike("[A-F]"), F.concat(F.array_join(F.transform(chars, cased), ""), beyond))
    return out.when(kind.isin("ip", "secret"), drawn).otherwise(upper)


def _full_kind(found: Column, before: Column, after: Column, following: Column) -> Column:
    """Type of a match. Names take gender and part from what stands around them."""
    kind, script = _kind(found), _script(found)
    keyed = before.rlike(rf"{_KEYED}{_SIGN}[\"']?$")
    is_given = after.rlike(rf"^{_GAP}$") & F.coalesce(_kind(following) == "name", F.lit(False))
    name = F.when(is_given, F.concat_ws("_", F.lit("given"), script, _gender(before))).otherwise(F.concat_ws("_", F.lit("surname"), script))
    return F.when((kind == "name") & keyed, "secret").when(kind == "name", name).otherwise(kind)


def _is_name(kind: Column) -> Column:
    return kind.startswith("given_") | kind.startswith("surname_")


def _with_mentions(rows: DataFrame, text: str) -> DataFrame:
    """Adds _names (canon, kind), the names that stand behind a title in a text, and extends _found
    and _pieces by their other mentions in that text as whole words, capitalised or in capitals."""
    found, pieces = F.col("_found"), F.col("_pieces")

    def one(x: Column, i: Column) -> Column:
        kind = _full_kind(x, pieces[i], pieces[i + 1], F.get(found, i + 1))
        return F.struct(F.lower(x).alias("canon"), kind.alias("kind"), x.alias("found"))

    names = F.filter(F.transform("_found", one), lambda x: _is_name(x["kind"]))
    names = F.when(F.col(text).rlike(_TITLED), names).otherwise(F.array().cast("array<struct<canon:string,kind:string,found:string>>"))
    rows = rows.withColumn("_names", F.array_distinct(names))
    spelled = F.flatten(F.transform("_names", lambda x: F.array(x["found"], F.upper(x["found"]), F.initcap(x["canon"]))))
    # Longer spellings are tried first.
    longest = F.array_sort(F.array_distinct(spelled), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    own = F.concat(F.lit(_ANY + r"|(?=\p{Lu})(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    rows = rows.withColumn("_own", F.when(F.size("_names") > 0, own))
    return rows.withColumns(
        {
            "_found": F.when(F.col("_own").isNull(), found).otherwise(F.regexp_extract_all(text, F.col("_own"), F.lit(0))),
            "_pieces": F.when(F.col("_own").isNull(), pieces).otherwise(F.split(F.col(text), F.col("_own"), -1)),
        }
    ).drop("_own")


def _occurrences(rows: DataFrame) -> DataFrame:
    """One row per match: _id, _hash, pos, found, kind, canon. Every mention of a name in a text is
    of one kind: given where any of them is."""
    at = rows.select("_id", "_hash", "_pieces", "_found", "_names", F.posexplode("_found").alias("pos", "found"))
    before, after = F.col("_pieces")[F.col("pos")], F.col("_pieces")[F.col("pos") + 1]
    kind = _full_kind(F.col("found"), before, after, F.get("_found", F.col("pos") + 1))
    at = at.select("_id", "_hash", "pos", "found", "_names", kind.alias("kind"))
    known = F.array_min(F.transform(F.filter("_names", lambda x: x["canon"] == F.lower("found")), lambda x: x["kind"]))
    at = at.withColumn("kind", F.when(_is_name(F.col("kind")), F.coalesce(known, "kind")).otherwise(F.col("kind"))).drop("_names")
    return at.withColumn("canon", _canon(F.col("kind"), F.col("found")))


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and n_entities, the number of replacements.

    Null and empty texts stay as they are, as do texts without entities, byte for byte. Repeated
    rows change alike. Rows need a doc_id column only to be told apart; it may be null. Other
    columns stay, but for one named n_entities, which is replaced.
    """
    docs, whole_rows = apart(docs, ("doc_id", text))
    found = F.when(F.col(text).rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), 0))
    marked = docs.withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    rows = marked.where(F.size("_found") > 0).withColumns(
        {
            "_pieces": F.split(F.col(text), _ANY, -1),
            "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
            "_hash": F.xxhash64(text),
        }
    )
    rows = stored(_with_mentions(rows, text))
    met = stored(_occurrences(rows))
    table = surrogates(met.select("kind", "canon").distinct(), key)
    # Dressed once per spelling, not per occurrence.
    spelled = met.select("kind", "canon", "found").distinct().join(table, ["kind", "canon"])
    spelled = stored(spelled.select("kind", "found", _dressed(F.col("kind"), F.col("found"), F.col("drawn")).alias("new")))
    new = met.join(spelled, ["kind", "found"]).groupBy("_id", "_hash").agg(F.collect_set(F.struct("pos", "new")).alias("_new"))
    words = F.transform(F.array_sort("_new"), lambda x: x["new"])
    whole = F.array_join(F.zip_with("_pieces", words, lambda p, w: F.concat(p, F.coalesce(w, F.lit("")))), "")
    changed = rows.join(new, ["_id", "_hash"]).withColumn(text, whole).withColumn("n_entities", F.size("_found"))
    clean = marked.where(F.size("_found") == 0).withColumn("n_entities", F.lit(0))
    names = [F.col(f"`{c}`") for c in (*docs.columns, "n_entities")]
    return whole_rows(changed.select(names).unionByName(clean.select(names)), ("n_entities",))
