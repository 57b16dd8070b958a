"""Operator 7: personal data replaced by surrogates. DataFrame expressions only.

Detected: e-mail addresses (letters of any script), telephone numbers (international ones after a plus sign, ten digits
in groups), IPv4 and IPv6 addresses, payment cards and IBANs (with right check digits), US social security numbers,
secrets assigned to a telling name or with the prefix of a well-known issuer, and persons with a title, however many
names follow. Not detected: names without a title, lower-case parts of names (van, de) and what follows them, other
national numbers, postal addresses, dates of birth.

Each entity is made of units of a kind (digits of a number, local part and domain of an address, given and family
names), and each unit gets a surrogate that depends on a key, its kind and its normal form alone, and for a name on the
gender that the titles in the whole corpus show. So the same entity has the same surrogate everywhere, however it is
written (an IPv6 address: in the same notation), a telephone number with and without its +1, a given name after Mr and
after Dr, a surname with and without a given name. Surrogates keep the format: separators, case, lengths, country
codes, check digits, prefixes of issuers; names keep gender and script.

Numbers, addresses and secrets go through keyed permutations of the texts of their shape, and initials through one of
their alphabet, so different ones stay different (an initial's surrogate may be another's own, as an alphabet has no
other letters). A full stop or a possessive 's after a name isn't part of it and stays. Names, and letters outside of the
Latin, Cyrillic and Greek alphabets, could meet; a check over the distinct units of the whole corpus finds every surrogate
that two units share, or that is itself a unit of the corpus, and gives all but one another try, until none is left.

Texts are searched once, and written with what was found. The units are settled from that column alone. Units whose
surrogate took another try are joined back by row: as a broadcast up to a size that is checked, else the rows that have
entities are joined by their number, one row each, so that no key is hot; rows without an entity are never moved. All
other surrogates are made in place.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.llm.common import free_name, write_table

MALE = ("Mr", "Mister", "Herr", "Monsieur", "M", "Señor", "Sr", "Господин", "г-н", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "г-жа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
GIVEN = {
    ("lat", "m"): "Adam Arthur Bruno Carl Daniel David Eric Felix Frank Henry Hugo Ivan James Julian Leon Lucas Mark Martin Max Oscar Paul Peter Simon Thomas Victor Walter",
    ("lat", "f"): "Alice Anna Bella Carla Clara Diana Elena Emma Eva Flora Grace Helen Ida Irene Jane Julia Laura Lena Lucy Maria Nina Nora Olga Rosa Sara Vera",
    ("lat", "n"): "Alex Ariel Casey Charlie Dana Eden Jamie Jordan Kim Lee Lou Morgan Noel Quinn Robin Sam Sasha Sidney Taylor Toni",
    ("cyr", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Илья Максим Михаил Николай Олег Павел Пётр Сергей",
    ("cyr", "f"): "Алина Анна Вера Дарья Елена Зоя Ирина Лариса Мария Нина Ольга Полина Светлана Юлия",
    ("cyr", "n"): "Женя Саша Валя Слава",
    ("gre", "m"): "Αλέξης Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος Στέφανος",
    ("gre", "f"): "Άννα Δήμητρα Ειρήνη Ελένη Κατερίνα Μαρία Σοφία Χρύσα",
    ("gre", "n"): "Αγγελος Ιωσηφ Σταυρος Φωτεινη",
}
SYLLABLES = {"lat": "ba be bo da de do fa ga go ha ka ke la le lo ma mo na no ra re ro sa so ta to va vi wa zo", "cyr": "ба бе во га го да де жо ка ки ла ло ма ми на но ра ро са со та ту", "gre": "βα γα δε δο κα κο λα λο μα μι να νο ρα ρο σα σο τα το"}
ENDINGS = {("lat", "m"): "rd", ("lat", "f"): "na", ("lat", "n"): "n", ("cyr", "m"): "в", ("cyr", "f"): "ва", ("cyr", "n"): "н", ("gre", "m"): "ς", ("gre", "f"): "να", ("gre", "n"): "ν"}

#: Prefixes of keys of well-known issuers, fixed values.
ISSUERS = ("sk-live-", "sk-test-", "sk-proj-", "sk-", "pk-live-", "pk-test-", "sk_live_", "sk_test_", "pk_live_", "pk_test_", "rk_live_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "xoxs-", "AKIA", "ASIA", "AIza", "hf_")
#: Country codes are one digit (1, 7), two (those listed) or three; the numbering plan's fixed values.
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

# Repetitions of unknown length are possessive: they take linear time and no stack, whatever the text. Patterns begin
# with what fails fast.
_NOT_IN_WORD = r"(?<![\p{L}\p{N}\p{M}])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LABEL = r"[\p{L}\p{N}\p{M}]++(?:-++[\p{L}\p{N}\p{M}]++)*+"
_EMAIL = rf"(?<![._+\-])[._+\-]*+[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}._+\-]*+@(?=[\p{{L}}\p{{N}}\p{{M}}.\-]*?\.\p{{L}}{{2}}){_LABEL}(?:\.{_LABEL})++"
_IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_IP6 = r"(?<![:.])(?=[0-9A-Fa-f]{1,4}:)(?=[A-Fa-f:]{0,38}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"
_PHONE = r"(?<![\p{L}\p{N}+])(?:(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[.\-])[0-9]{3}[ .\-][0-9]{4}|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){3,4})(?![\p{L}\p{N}])"
_SSN = r"(?<![\p{L}\p{N}\-])(?!000|666|9[0-9][0-9])[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\p{L}\p{N}\-])"
_CARD = r"(?<![\p{L}\p{N}.\-])(?=4|5[1-5]|2[2-7]|3[0-9]|6)(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![\p{L}\p{N}\-]|\.[0-9])"
_IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])"
_TELLING = r"""\b(?i:token|secret|password|passwd|api[_\-]?key|access[_\-]?key|secret[_\-]?key)["']?[ ]{0,3}[=:]"""
#: With the character before it, which tells it from other kinds. A word of letters alone is one if it is long or of mixed case.
_SECRET = rf"""[=: "'](?=[A-Za-z0-9+/_\-]{{16}})(?<={_TELLING}[ ]{{0,3}}["']?)(?=[A-Za-z+/_\-]*+[0-9]|[A-Za-z+/_\-]{{24}}|[A-Z+/_\-]*+[a-z+/_\-]++[A-Z])[A-Za-z0-9+/_\-]++"""
_ISSUED_KEY = rf"(?=[{''.join(sorted({x[0] for x in ISSUERS}))}])(?:{'|'.join(ISSUERS)})(?=[A-Za-z_\-]*+[0-9])[A-Za-z0-9_\-]{{16,}}+"
_TITLE = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
_CAPITAL = "".join(sorted({t[0] for t in _TITLE.split("|")}))
_TITLED = rf"(?:(?:{_TITLE})\.|(?:{'|'.join(t for t in _TITLE.split('|') if t != 'M')}))"
_PERSON = rf"(?=[{_CAPITAL}]){_TITLED} \p{{Lu}}(?:\.|[\p{{L}}\p{{M}}'’\-]*+)(?: \p{{Lu}}(?:\.|[\p{{L}}\p{{M}}'’\-]++|(?= \p{{Lu}})))*+"
#: Social security numbers that can be.
_ISSUED = "^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"
#: Alternatives are tried in this order at each place.
_ANY = rf"{_SECRET}|{_NOT_IN_WORD}(?:{_EMAIL}|{_ISSUED_KEY}|{_IP6}|{_IBAN}|{_PERSON})|(?=[0-9+(])(?:{_IP}|{_PHONE}|{_SSN}|{_CARD})"
#: What every entity has; most texts have none of it. Each part begins with one character, so that it fails fast.
_HINT = rf"[0-9@]|[=:](?<={_TELLING})|[{_CAPITAL}](?<={_NOT_IN_WORD}.)(?:{'|'.join(rf'(?<={c})(?:{"|".join(t[1:] for t in _TITLE.split("|") if t[0] == c)})' for c in _CAPITAL)})\.? \p{{Lu}}"
_DIGITS = ("phone", "ssn", "card")
_LEAD = r"^[._+\-]+"


def found(text: Column) -> Column:
    """All candidates in a text, in order."""
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_sum(digits: Column, first: int) -> Column:
    """The sum of the digits from the right; every second is doubled, beginning with the first or second (0 or 1)."""

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == first, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + value(i))


def _mod_97(x: Column) -> Column:
    """The remainder of a text of digits and capital letters (A: 10, B: 11, ...)."""

    def step(r: Column, c: Column) -> Column:
        return (F.when(c.rlike("[0-9]"), r * 10 + c.cast("long")).otherwise(r * 100 + F.ascii(c) - 55) % 97).cast("long")

    return F.aggregate(F.split(x, ""), F.lit(0).cast("long"), step)


def kind_of(entity: Column) -> Column:
    """The kind of a candidate; null for a number whose check digit is wrong."""
    compact = F.replace(entity, F.lit(" "), F.lit(""))
    out = F.when(entity.rlike("^[=: \"']"), "secret").when(entity.contains("@"), "email").when(entity.rlike(f"^(?:{'|'.join(ISSUERS)})") & ~entity.contains(" "), "key")
    out = out.when(entity.rlike("^[0-9A-Fa-f]*:[0-9A-Fa-f:]*$"), "ip6").when(entity.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip").when(entity.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
    card = entity.rlike("^(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$")
    out = out.when(card, F.when(_luhn_sum(_digits(entity), 1) % 10 == 0, F.lit("card")))
    iban = F.when(_mod_97(F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))) == 1, F.lit("iban"))
    out = out.when(entity.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$"), iban)
    return out.when(entity.rlike(r"^[+(0-9][0-9() .+\-]*[0-9]$"), "phone").otherwise("person")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyr").when(word.rlike(r"\p{IsGreek}"), "gre").otherwise("lat")


def _gender(title: Column) -> Column:
    bare = F.regexp_replace(title, r"\.$", "")
    return F.when(bare.isin(*MALE), "m").when(bare.isin(*FEMALE), "f").otherwise("n")


#: What may follow a name and isn't part of it.
_AFTER = r"(?:\.|['’][sS]?)$"


def _name(words: Column, i: Column) -> Column:
    """Kind, normal form and gender of the i-th word after the title (from 1); the last is the family name, whose gender
    shows in some scripts."""
    word = F.element_at(words, i + 1)
    bare, script = F.regexp_replace(word, _AFTER, ""), _script(word)
    last, initial = i == F.size(words) - 1, word.rlike(r"^\p{Lu}\.?$")
    kind = F.when(last, F.concat(F.lit("family-"), script)).when(initial, F.concat(F.lit("initial-"), script)).otherwise(F.concat(F.lit("given-"), script))
    gender = F.when(last & (script == "lat"), F.lit("n")).otherwise(_gender(F.element_at(words, F.lit(1))))
    return _unit(kind, F.when(initial & ~last, bare).otherwise(F.lower(bare)), gender)


def _unit(kind: Column, norm: Column, gender: Column) -> Column:
    return F.struct(kind.alias("kind"), norm.alias("norm"), gender.alias("gender"))


def entities(text: Column) -> Column:
    """The candidates of a text with their kinds and units: structs of entity, kind and units (structs of kind, norm and
    gender, which only names have)."""
    kinds = F.transform(found(text), lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind")))
    return F.transform(kinds, lambda h: F.struct(h["entity"].alias("entity"), h["kind"].alias("kind"), _units(h["entity"], h["kind"]).alias("units")))


def _units(entity: Column, kind: Column) -> Column:
    unit = lambda k, n: _unit(F.lit(k) if isinstance(k, str) else k, n, F.lit(""))
    digits = _digits(entity)
    names = _let(F.split(entity, " "), lambda words: F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: _name(words, i)))
    plus = F.when(entity.startswith("+") & ~(digits.startswith("1") & (F.length(digits) == 11)), F.concat(F.lit("+"), digits))
    return (
        F.when(kind == "email", F.array(unit("local", F.lower(F.regexp_replace(F.substring_index(entity, "@", 1), _LEAD, ""))), unit("domain", F.lower(F.substring_index(entity, "@", -1)))))
        .when(kind == "phone", F.array(unit(kind, F.coalesce(plus, F.right(digits, F.least(F.length(digits), F.lit(10)))))))
        .when(kind.isin("ssn", "card"), F.array(unit(kind, digits)))
        .when(kind == "iban", F.array(unit(kind, F.replace(entity, F.lit(" "), F.lit("")))))
        .when(kind == "secret", F.array(unit(kind, F.substring(entity, F.lit(2), F.length(entity)))))
        .when(kind.isin("ip", "key"), F.array(unit(kind, entity)))
        .when(kind == "ip6", F.array(unit(kind, F.lower(entity))))
        .when(kind == "person", names)
        .otherwise(F.array().cast("array<struct<kind:string,norm:string,gender:string>>"))
    )


def _number(key: Column, *parts: Column) -> Column:
    """A keyed number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", key, *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("long")


def _permuted(left: Column, right: Column, size_l: Column, size_r: Column, *seed: Column) -> Column:
    """A keyed permutation of pairs below the two sizes: rounds that each add to one half a number from the other."""

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        left_ = F.when(odd, (s["l"] + _number(*seed, i, s["r"]) % size_l) % size_l).otherwise(s["l"])
        right_ = F.when(odd, s["r"]).otherwise((s["r"] + _number(*seed, i, s["l"]) % size_r) % size_r)
        return F.struct(left_.cast("long").alias("l"), right_.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _permuted_digits(digits: Column, *seed: Column) -> Column:
    """Another string of as many digits; at least 2, at most 34."""
    a = F.floor(F.length(digits) / 2).cast("int")
    b = F.length(digits) - a
    size = lambda n: F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")
    s = _permuted(F.substring(digits, F.lit(1), a).cast("long"), F.substring(digits, a + 1, b).cast("long"), size(a), size(b), *seed)
    return F.concat(F.lpad(s["l"].cast("string"), a, F.lit("0")), F.lpad(s["r"].cast("string"), b, F.lit("0")))


_LATIN = "abcdefghijklmnopqrstuvwxyz"
_LETTERS = (_LATIN, _LATIN.upper())
#: Alphabets within which a character is replaced.
_WITHIN = ("0123456789", *_LETTERS, "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")


def _let(x: Column, f) -> Column:
    """f of x, which is computed once however often f uses it."""
    return F.transform(F.array(x), f)[0]


def _stream(n: Column, *seed: Column) -> Column:
    """Keyed hexadecimal digits, four for each of n characters."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / 32).cast("int")), lambda b: F.sha2(F.concat_ws("\x1f", *(x.cast("string") for x in seed), b.cast("string")), 512))
    return F.array_join(blocks, "")


def _shifted(x: Column, hexes: Column, stream: Column) -> Column:
    """Each character of x moved along its alphabet by the numbers in the stream; what is in no alphabet stays."""

    def one(c: Column, i: Column, numbers: Column) -> Column:
        alphabet = F.when(F.lit(_WITHIN[0]).contains(c), _WITHIN[0])
        for a in _WITHIN[1:]:
            alphabet = alphabet.when(F.lit(a).contains(c), F.substring(F.lit(a), F.lit(1), F.when(hexes, 6).otherwise(len(a))) if a in _LETTERS else F.lit(a))
        number = F.conv(F.substring(numbers, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return _let(alphabet, lambda a: F.when(a.isNull(), c).otherwise(F.substring(a, (F.instr(a, c) - 1 + number) % F.length(a) + 1, F.lit(1))))

    moved = _let(stream, lambda numbers: F.array_join(F.transform(F.split(x, ""), lambda c, i: one(c, i, numbers)), ""))
    return F.when(F.length(x) == 0, x).otherwise(moved)


def _same_shape(x: Column, hexes: Column, *seed: Column) -> Column:
    """A keyed permutation of the texts of a shape: digits for digits, letters for letters of the same case and alphabet;
    all else stays. Each half is moved by numbers that follow from the other, in turn. Letters of no alphabet are first
    put into the Latin one, where they may meet others. hexes: a text of hexadecimal digits stays one."""
    known = "".join(_WITHIN)
    foreign = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{known}]]"
    put = lambda c: F.when(c.rlike(foreign), F.substring(F.lit(_LATIN), (_number(*seed, c) % 26).cast("int") + 1, F.lit(1))).otherwise(c)

    def step(s: Column, i: Column) -> Column:
        """Moves the first half by the second, and swaps them."""
        moved = _shifted(s["l"], s["hex"], _stream(F.length(s["l"]), *seed, i, s["r"]))
        return F.struct(s["r"].alias("l"), moved.alias("r"), s["hex"].alias("hex"))

    def permuted(plain: Column) -> Column:
        cut = F.floor(F.length(plain) / 2).cast("int")
        halves = F.struct(F.substring(plain, F.lit(1), cut).alias("l"), F.substring(plain, cut + 1, F.length(plain)).alias("r"), (hexes & plain.rlike("^[0-9a-fA-F:]+$")).alias("hex"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), halves, step, lambda s: F.concat(s["l"], s["r"]))

    return _let(F.when(x.rlike(foreign), F.array_join(F.transform(F.split(x, ""), put), "")).otherwise(x), permuted)


def _by_pool(values: dict) -> Column:
    return F.create_map(*(F.lit(x) if isinstance(x, str) else x for (script, gender), v in values.items() for x in (f"{script}-{gender}", v)))


def _words(x: str) -> Column:
    return F.split(F.lit(x), " ")


def _new_name(pool: Column, given: Column, attempt: Column, *seed: Column) -> Column:
    """A given name from the pool, at first; else, and for family names, one made of syllables, longer with each try."""
    pick = lambda xs, *more: F.try_element_at(xs, (_number(*seed, attempt, *more) % F.greatest(F.size(xs), F.lit(1))).cast("int") + 1)
    names = F.try_element_at(_by_pool({k: _words(x) for k, x in GIVEN.items()}), pool)
    syllables = F.try_element_at(_by_pool({k: _words(SYLLABLES[k[0]]) for k in GIVEN}), pool)
    ending = F.try_element_at(_by_pool(ENDINGS), pool)
    made = F.initcap(F.concat(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda j: pick(syllables, j)), ""), ending))
    return F.when(given & (attempt == 0), pick(names, F.lit("p"))).otherwise(made)


#: Letters that initials have in practice; others go by script and block.
_ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")


def _capitals() -> list[str]:
    groups: dict = {c: a for a in _ALPHABETS for c in a}
    out: dict = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.category(c) == "Lu":
            out.setdefault(groups.get(c, (unicodedata.name(c).split()[0], ord(c) >> 7)), []).append(c)
    alone = [k for k, v in out.items() if len(v) == 1]
    return ["".join(v) for k, v in out.items() if k not in alone] + ["".join(out[k][0] for k in alone)]


_CAPITALS = _capitals()


def permuted_capitals(key: str) -> tuple[str, str]:
    """All capital letters, and each one's surrogate: the next in its alphabet in a keyed order, so none stays."""
    old = ["".join(sorted(a, key=lambda c: hashlib.sha256(f"{key}\x1finitial\x1f{c}".encode()).digest())) for a in _CAPITALS]
    return "".join(old), "".join(a[1:] + a[:1] for a in old)


def surrogate(kind: Column, norm: Column, gender: Column, attempt: Column, secret: str) -> Column:
    """The surrogate of a unit, in normal form (names begin with a capital)."""
    key = F.lit(secret)
    seed = (key, kind, attempt)
    rest = lambda at: F.substring(norm, at, F.length(norm))
    label = F.substring_index(norm, ".", 1)
    # what stays in front, and what is permuted; of a card the network stays, of a domain the rest decides with
    stays = F.when(kind == "phone", F.regexp_extract(norm, _COUNTRY, 0)).when(kind.isin("card", "iban"), F.substring(norm, 1, 2)).when(kind == "key", F.regexp_extract(norm, f"^(?:{'|'.join(ISSUERS)})", 0)).otherwise("")
    core = lambda front: F.when(kind == "domain", label).when(kind == "iban", rest(F.lit(5))).when(kind == "card", F.substring(norm, F.lit(3), F.length(norm) - 3)).otherwise(rest(F.length(front) + 1))
    # a try is longer than the one before it, so that short parts don't run out
    longer = lambda x: F.when(attempt > 0, x).otherwise("")
    before, after = longer(F.concat(F.lit("m"), attempt.cast("string"), F.lit("."))), longer(F.concat(F.lit("."), attempt.cast("string")))

    def number(p: Column) -> Column:
        check = lambda d: F.when(kind == "card", F.concat(d, ((F.lit(10) - _luhn_sum(d, 0) % 10) % 10).cast("string"))).otherwise(d)
        return _let(F.concat(p["stays"], _permuted_digits(p["core"], *seed)), check)

    def shape(p: Column) -> Column:
        own = F.when(kind == "domain", rest(F.length(label) + 1)).otherwise(p["stays"])
        iban = lambda x: F.concat(p["stays"], F.lpad((F.lit(98) - _mod_97(F.concat(x, p["stays"], F.lit("00")))).cast("string"), 2, "0"), x)
        domain = lambda x: F.concat(before, x, F.lit(".example."), F.substring_index(norm, ".", -1))
        return _let(_same_shape(p["core"], kind.isin("secret", "ip6"), *seed, own), lambda x: F.when(kind == "domain", domain(x)).when(kind == "iban", iban(x)).otherwise(F.concat(p["stays"], x, F.when(kind == "local", after).otherwise(""))))

    octet = lambda i: F.try_element_at(F.split(norm, r"\."), F.lit(i)).cast("long")
    ip = _let(_permuted(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536), *seed), lambda h: F.concat_ws(".", *((F.floor(h[k] / 256) if high else h[k] % 256).cast("string") for k in "lr" for high in (True, False))))
    numeric = kind.isin(*_DIGITS)
    cut = _let(stays, lambda front: _let(F.struct(front.alias("stays"), core(front).alias("core")), lambda p: F.when(numeric, number(p)).otherwise(shape(p))))
    named = _new_name(F.concat_ws("-", F.regexp_replace(kind, "^[a-z]+-", ""), gender), kind.startswith("given"), attempt, key, kind, norm)
    out = F.when(kind == "ip", ip).when(kind.rlike("^(given|family)-"), named)
    return out.when(kind.startswith("initial-"), F.translate(norm, *permuted_capitals(secret))).otherwise(cut)


def rendered(entity: Column, kind: Column, new: Column) -> Column:
    """An entity with its units' surrogates in their place; a candidate of no kind stays."""
    words, first = F.split(entity, " "), F.try_element_at(new, F.lit(1))
    cased = lambda x, old: F.when((F.upper(old) == old) & (F.lower(old) != old) & (F.length(old) > 1), F.upper(x)).otherwise(x)
    # letters and digits of the entity from the right; a country code that isn't in the unit stays
    old, given = F.regexp_replace(entity, "[^0-9A-Za-z]", ""), F.regexp_replace(first, r"^\+", "")
    full = F.concat(F.substring(old, F.lit(1), F.length(old) - F.length(given)), given)

    def step(s: Column, c: Column) -> Column:
        own = c.rlike("[0-9A-Za-z]")
        return F.struct((s["i"] + own.cast("int")).alias("i"), F.concat(s["out"], F.when(own, F.substring(full, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    number = F.aggregate(F.split(entity, ""), F.struct(F.lit(0).alias("i"), F.lit("").alias("out")), step, lambda s: s["out"])
    person = F.concat_ws(" ", F.element_at(words, F.lit(1)), F.zip_with(F.slice(words, F.lit(2), F.size(words)), new, lambda w, x: F.concat(cased(x, F.regexp_replace(w, _AFTER, "")), F.regexp_extract(w, _AFTER, 0))))
    out = F.when(kind == "email", F.concat(F.regexp_extract(entity, _LEAD, 0), cased(F.concat_ws("@", new), entity))).when(kind.isin(*_DIGITS, "iban"), number)
    out = out.when(kind == "secret", F.concat(F.substring(entity, 1, 1), first)).when(kind == "ip6", cased(first, entity))
    return out.when(kind.isin("ip", "key"), first).when(kind == "person", person).otherwise(entity)


def distinct_units(hits: DataFrame, column: str = "hits") -> DataFrame:
    """kind, norm, gender and mixed. The gender of a name is that of the titles it has anywhere, if they agree (neutral
    ones don't count); mixed says that it had another somewhere."""
    each = hits.select(F.explode(F.flatten(F.col(f"`{column}`")["units"])).alias("u")).select("u.kind", "u.norm", "u.gender")
    seen = each.groupBy("kind", "norm").agg(*(F.max(F.col("gender") == g).alias(g) for g in "mfn"))
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").when(F.col("m") | F.col("n"), "n").otherwise("")
    return seen.select("kind", "norm", gender.alias("gender"), (F.col("m").cast("int") + F.col("f").cast("int") + F.col("n").cast("int") > 1).alias("mixed"))


def resolve(units_: DataFrame, key: str, tries: int = 40) -> DataFrame:
    """kind, norm, surrogate of those units that can't have the first surrogate that their texts show: another unit has it
    too (one of them may keep it), it is itself a unit of that kind, no number of its kind can be so, or the name's gender
    differs from some title's. Raises ValueError if some unit has none after all tries."""
    fold = F.lower  # surrogates are compared as units are
    names = ("kind", "norm", "gender", "mixed")
    made = lambda df: df.withColumn("s", surrogate(F.col("kind"), F.col("norm"), F.col("gender"), F.col("attempt"), key))
    # dealt by number from a table, as a unit is few bytes and much work, and small partitions would be put together
    n = int(units_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo = write_table(units_, "units").filter(~F.col("kind").startswith("initial")).repartition(n, "kind", "norm").withColumn("attempt", F.lit(0))
    todo, settled, overrides = write_table(made(todo), "surrogates"), None, None
    everything = todo.select("kind", F.col("norm").alias("other"))
    for attempt in range(tries):
        candidates = todo.withColumn("folded", fold("s"))
        hit = candidates.join(everything.select("kind", F.col("other").alias("folded"), F.lit(1).alias("real")), ["kind", "folded"], "left")
        if settled is not None:
            hit = hit.join(settled.select("kind", "folded", F.lit(1).alias("used")), ["kind", "folded"], "left")
        else:
            hit = hit.withColumn("used", F.lit(None).cast("int"))
        first = hit.groupBy("kind", "folded").agg(F.min("norm").alias("first"))
        judged = hit.join(first, ["kind", "folded"]).withColumn("ok", F.col("real").isNull() & F.col("used").isNull() & (F.col("norm") == F.col("first")) & ((F.col("kind") != "ssn") | F.col("s").rlike(_ISSUED)))
        judged = write_table(judged.select(*names, "s", "folded", "ok"), "judged")
        good, bad = judged.filter("ok"), judged.filter("NOT ok")
        settled = good.select("kind", "folded") if settled is None else settled.unionByName(good.select("kind", "folded"))
        new = (good if attempt else good.filter("mixed")).select("kind", "norm", F.col("s").alias("surrogate"))
        overrides = new if overrides is None else overrides.unionByName(new)
        if bad.isEmpty():
            return overrides
        todo = write_table(made(bad.select(*names).withColumn("attempt", F.lit(attempt + 1))), "surrogates")
    raise ValueError(f"{todo.count()} units have no surrogate of their own after {tries} tries")


def replace_pii(df: DataFrame, key: str, text: str = "text", n_entities: str = "n_entities", small: int = 32 << 20) -> DataFrame:
    """df with personal data in the text column replaced, and the number of entities that were; a column of that name is
    replaced. Null text stays null, with none. Texts without an entity, empty and very long ones among them, stay as they
    are, byte for byte; of long texts all entities are replaced. Repeated rows come out alike, each of them; no row is told
    by its doc_id. An empty table stays empty. All other columns go through, whatever their names. The key decides all
    surrogates; keep it secret, and use the same for what must match. small: bytes of second tries up to which each task
    gets them all; beyond, rows with entities are joined by their number."""
    names = [c for c in df.columns if c.lower() != n_entities.lower()]
    own = {c: f"c{i}" for i, c in enumerate(names)}  # columns of any name can be written and don't clash
    body, hits, between = F.col(own[text]), F.col("hits"), F.col("between")
    rows = df.select(*(F.col(f"`{c}`").alias(own[c]) for c in names)).withColumn("hits", entities(body))
    any_ = F.coalesce(F.size("hits") > 0, F.lit(False))
    rows = rows.withColumn("between", F.when(any_, F.split(body, _ANY, -1))).withColumn(own[text], F.when(~any_, body)).withColumn("row", F.monotonically_increasing_id())
    rows = write_table(rows, "found")

    overrides = write_table(resolve(distinct_units(rows), key), "overrides")
    mine = rows.select("row", F.explode(F.array_distinct(F.flatten(hits["units"]))).alias("u")).select("row", "u.kind", "u.norm").distinct()
    name_of = lambda kind, norm: F.concat_ws("\x1f", kind, norm)
    maps = mine.join(overrides, ["kind", "norm"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(name_of(F.col("kind"), F.col("norm")).alias("k"), F.col("surrogate").alias("v")))).alias("again"))
    maps = write_table(maps, "second-tries")
    size = maps.agg(F.sum(F.lit(16) + F.octet_length(F.to_json("again")))).first()[0]
    plain = rows.withColumn("again", F.lit(None).cast("map<string,string>"))
    if size is None:
        rows = plain
    elif size <= small:
        rows = rows.join(F.broadcast(maps), "row", "left")
    else:
        touched = F.col("between").isNotNull()
        rows = plain.filter(~touched).unionByName(rows.filter(touched).join(maps, "row", "left"))

    first = lambda u: F.coalesce(F.try_element_at(F.col("again"), name_of(u["kind"], u["norm"])), surrogate(u["kind"], u["norm"], u["gender"], F.lit(0), key))
    made = F.transform(hits, lambda h: F.struct(h["entity"].alias("entity"), h["kind"].alias("kind"), F.transform(h["units"], first).alias("new")))
    new = F.transform(made, lambda h: rendered(h["entity"], h["kind"], h["new"]))
    woven = F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    real, touched = F.size(F.filter(hits, lambda h: h["kind"].isNotNull())), between.isNotNull()
    return rows.select(*(F.when(touched, woven).otherwise(body).alias(c) if c == text else F.col(own[c]).alias(c) for c in names), F.when(touched, real).otherwise(0).cast("long").alias(n_entities))
