"""Format-preserving pseudonyms for personal data, in SQL expressions alone.

Found are card numbers (Luhn), bank account numbers (ISO 13616, remainder 97), social security numbers, telephone
numbers, IPv4 addresses and dates, each only if valid, and e-mail addresses. A number or date is permuted within its own
format by a keyed Feistel network: digits stay digits, separators stay where they are, check digits are computed anew,
dates stay dates. The permutation depends on the key and the kind alone, so equal values have equal pseudonyms in every
document and different values never meet. An e-mail address, which is no number, becomes a keyed digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.plans.storage import spread_out

ROUNDS = 8
#: The Gregorian calendar repeats after so many days; 189 * 773 of them from 1800-01-01 are permuted as one domain.
DAYS_HIGH, DAYS_LOW = 189, 773

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
DATE = r"(?<![\w./\-])(?:\d{4}-\d{2}-\d{2}|\d{2}([/.\-])\d{2}\1\d{4})(?![\w/]|[.\-]\d)"
SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)"
IPV4 = rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .\-]?\d{2,4}){2,3}(?!\w)|(?<![\w+(])(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[.\-]\d{4}(?!\w)"
CARD = r"(?<![\w.])\d(?:[ \-]?\d){12,18}(?!\w|\.\d)"
ANY = "|".join((EMAIL, IBAN, DATE, SSN, IPV4, PHONE, CARD))
#: Characters of an account number by country (ISO 13616 registry), where a match can hold words or numbers that follow.
IBAN_LENGTHS = dict(AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20)
#: A text without either has none of the above, so that most texts meet one cheap test only.
HINT = r"@|[0-9][ .\-/]?[0-9]"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _feistel(kind: str, left: str, right: str, left_mod: str, right_mod: str, key: str) -> str:
    """SQL for struct<l,r> after ROUNDS rounds; each adds a keyed hash of one half to the other, modulo its size."""
    def add(half: str, other: str, mod: str) -> str:
        digest = f"conv(substr(sha2(concat_ws('|', {key}, '{kind}', {left_mod}, {right_mod}, i, s.{other}), 256), 1, 15), 16, 10)"
        return f"pmod(s.{half} + cast({digest} as bigint) % {mod}, {mod})"

    step = f"if(i % 2 = 1, named_struct('l', {add('l', 'r', left_mod)}, 'r', s.r), named_struct('l', s.l, 'r', {add('r', 'l', right_mod)}))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> {step})"


def _permuted(kind: str, digits: str, key: str) -> str:
    """SQL for the permuted digits, as many as there were."""
    half = f"cast(length({digits}) div 2 as int)"
    net = _feistel(kind, f"substr({digits}, 1, {half})", f"substr({digits}, {half} + 1)", f"cast(pow(10, {half}) as bigint)", f"cast(pow(10, length({digits}) - {half}) as bigint)", key)
    return f"transform(array({net}), p -> concat(lpad(cast(p.l as string), {half}, '0'), lpad(cast(p.r as string), length({digits}) - {half}, '0')))[0]"


def _luhn(digits: str, doubled: int) -> str:
    """SQL for the Luhn sum; from the right, every second digit counts double, the first of them at place `doubled`."""
    digit = f"cast(substr({digits}, length({digits}) - k + 1, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (t, k) -> t + if(k % 2 = {doubled}, {digit} * 2 - if({digit} > 4, 9, 0), {digit}))"


def _laid_out(shape: str, digits: str) -> str:
    """SQL for `shape` with its digits replaced by `digits` in order."""
    return f"array_join(transform(sequence(1, length({shape})), j -> if(substr({shape}, j, 1) rlike '[0-9]', substr({digits}, length({_digits(f'substr({shape}, 1, j)')}), 1), substr({shape}, j, 1))), '')"


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with `name` bound to value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _mod97(text: str) -> str:
    one = f"substr({text}, k, 1)"
    return f"aggregate(sequence(1, length({text})), 0, (t, k) -> if({one} rlike '[0-9]', (t * 10 + cast({one} as int)) % 97, (t * 100 + ascii({one}) - 55) % 97))"


def _first_valid(kept: str, least: int, part: str, valid: str, fresh: str, rest: str = "r") -> str:
    """SQL for m with its longest valid part from the start replaced, or m itself if there is none.

    A part ends where a group of characters `kept` ends, as numbers that follow a value match with it. valid and fresh
    see the part as m; `rest` is what the remainder r becomes.
    """
    ends = f"substr(m, e, 1) rlike '{kept}' and (e = length(m) or not substr(m, e + 1, 1) rlike '{kept}')"
    good = f"transform(array(named_struct('m', substr(m, 1, e), 'whole', e = length(m))), u -> {_let('u.m', 'm', _let(part, 'c', valid))})[0]"
    cut = f"get(filter(sequence(length(m), {least}, -1), e -> if({ends}, {good}, false)), 0)"
    done = f"concat({_let('substr(m, 1, e)', 'm', _let(part, 'c', fresh))}, {_let('substr(m, e + 1)', 'r', rest)})"
    return _let(cut, "e", f"if(e is null, m, {done})")


def _card(key: str) -> str:
    fresh = _let(_permuted("card", "substr(c, 1, length(c) - 1)", key), "p", f"concat(p, (10 - {_luhn('p', 1)} % 10) % 10)")
    valid = f"length(c) >= 13 and {_luhn('c', 0)} % 10 = 0 and c rlike '[1-9]'"
    return _first_valid("[0-9]", 13, _digits("m"), valid, _let(fresh, "q", _laid_out("m", "q")))


def _phone(key: str) -> str:
    code = r"regexp_extract(m, '^(\\+\\d{1,3}[ .\\-]?)?(.*)$', 1)"
    rest = r"regexp_extract(m, '^(\\+\\d{1,3}[ .\\-]?)?(.*)$', 2)"
    return _let(rest, "w", _let(_digits("w"), "d", f"concat({code}, {_let(_permuted('phone', 'd', key), 'q', _laid_out('w', 'q'))})"))


def _ipv4(key: str) -> str:
    part = "cast(o[{}] as bigint)"
    net = _feistel("ipv4", f"{part.format(0)} * 256 + {part.format(1)}", f"{part.format(2)} * 256 + {part.format(3)}", "65536L", "65536L", key)
    return _let("split(m, '[.]')", "o", _let(net, "p", "concat_ws('.', p.l div 256, p.l % 256, p.r div 256, p.r % 256)"))


def _ssn(key: str) -> str:
    valid = "o[0] not in ('000', '666') and o[0] < '900' and o[1] <> '00' and o[2] <> '0000'"
    area = "cast(o[0] as int) - if(o[0] > '666', 2, 1)"
    net = _feistel("ssn", area, "(cast(o[1] as int) - 1) * 9999 + cast(o[2] as int) - 1", "898L", "989901L", key)
    text = "concat_ws('-', lpad(cast(p.l + if(p.l >= 665, 2, 1) as string), 3, '0'), lpad(cast(p.r div 9999 + 1 as string), 2, '0'), lpad(cast(p.r % 9999 + 1 as string), 4, '0'))"
    return _let("split(m, '-')", "o", f"if({valid}, {_let(net, 'p', text)}, m)")


def _date(key: str) -> str:
    iso = "m rlike '^[0-9]{4}'"
    day_first = "try_cast(concat_ws('-', substr(m, 7, 4), substr(m, 4, 2), substr(m, 1, 2)) as date)"
    month_first = "try_cast(concat_ws('-', substr(m, 7, 4), substr(m, 1, 2), substr(m, 4, 2)) as date)"
    day = f"if({iso}, try_cast(m as date), coalesce({day_first}, {month_first}))"
    net = _feistel("date", f"n div {DAYS_LOW}", f"n % {DAYS_LOW}", f"{DAYS_HIGH}L", f"{DAYS_LOW}L", key)
    shaped = f"date_format(e, case when {iso} then 'yyyy-MM-dd' when {day_first} is not null then concat('dd', substr(m, 3, 1), 'MM', substr(m, 3, 1), 'yyyy') else concat('MM', substr(m, 3, 1), 'dd', substr(m, 3, 1), 'yyyy') end)"
    fresh = _let(net, "p", _let(f"date_add(date'1800-01-01', cast(p.l * {DAYS_LOW} + p.r as int))", "e", shaped))
    return _let(f"datediff({day}, date'1800-01-01')", "n", f"if(n between 0 and {DAYS_HIGH * DAYS_LOW - 1}, {fresh}, m)")


def _iban(key: str) -> str:
    """The country and any letters stay; the account's digits are permuted and the two check digits computed anew."""
    own = "case substr(c, 1, 2) " + " ".join(f"when '{k}' then {n}" for k, n in IBAN_LENGTHS.items()) + " else length(c) end"
    valid = f"(u.whole or length(c) = {own}) and {_mod97('concat(substr(c, 5), substr(c, 1, 4))')} = 1"
    fresh = _let(_digits("substr(c, 5)"), "d", _let(_permuted("iban", "d", key), "q", _let(_laid_out("substr(c, 5)", "q"), "b", f"concat(lpad(cast(98 - {_mod97('concat(b, substr(c, 1, 2), 0, 0)')} as string), 2, '0'), {_digits('b')})")))
    # the remainder can be a card
    rest = f"if(ltrim(r) rlike {_whole(CARD)}, concat(' ', {_let('ltrim(r)', 'm', _card(key))}), r)"
    return _first_valid("[A-Z0-9]", 12, "replace(m, ' ', '')", valid, _let(fresh, "q", _laid_out("m", "q")), rest)


def _email(key: str) -> str:
    return f"concat('user-', substr(sha2(concat_ws('|', {key}, 'email', lower(m)), 256), 1, 12), '@mail.invalid')"


def _whole(pattern: str) -> str:
    return "'^(?:" + pattern.replace("\\", "\\\\").replace("'", "\\'") + ")$'"


def replacement(key: str) -> str:
    """SQL for a lambda over one match m: its pseudonym, or m itself if it is not valid."""
    kinds = ((EMAIL, _email), (IBAN, _iban), (DATE, _date), (SSN, _ssn), (IPV4, _ipv4), (PHONE, _phone), (CARD, _card))
    quoted = "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "case " + " ".join(f"when m rlike {_whole(p)} then {f(quoted)}" for p, f in kinds) + " else m end"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_replaced") -> DataFrame:
    """The rows with personal data in text_col replaced; all other columns, the rows and their order as they were.

    count_col, if named, is added and tells how many values were replaced. Null and empty texts stay, with count 0.
    Values that look like a kind but fail its check (a number without a valid check digit, February 30) stay.
    Everything happens within the row: no shuffle, no Python. Repeated rows and null ids are treated like others.
    """
    found, kept, fresh = "__pii_found", "__pii_kept", "__pii_fresh"
    plain = ~F.col(text_col).rlike(HINT) | F.col(text_col).isNull()
    out = spread_out(docs).withColumn(found, F.when(plain, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0))))
    out = out.withColumn(fresh, F.expr(f"transform({found}, m -> {replacement(key)})"))
    out = out.withColumn(kept, F.when(F.size(found) > 0, F.split(F.col(text_col), ANY, -1)))
    joined = F.array_join(F.zip_with(kept, F.concat(fresh, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    out = out.withColumn(text_col, F.when(F.size(found) > 0, joined).otherwise(F.col(text_col)))
    if count_col:
        out = out.withColumn(count_col, F.size(F.filter(F.arrays_zip(F.col(found).alias("x"), F.col(fresh).alias("y")), lambda z: z["x"] != z["y"])))
    return out.drop(found, kept, fresh)
