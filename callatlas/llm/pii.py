"""Format-preserving pseudonyms by keyed Feistel permutations, with DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
#: Days that are permuted: 1900-01-01 to 2099-12-31 are 73049 = 229 * 319 days.
FIRST_DAY, DAYS = "1900-01-01", (229, 319)
#: What is looked for, first match first: e-mail addresses, dates, IPv4 addresses, phone numbers, digit groups. All repeats of
#: groups are bounded and a match starts at the start of a run, so that no text takes more than linear time or a deep stack.
#: A name before the @ has 64 characters at most; of a domain, eight labels of 63 and the one after them count.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,63}"
DATE = r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w-])"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
CARD = r"(?<!\w)\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,4}(?:[ -]?\d{1,3})?(?!\w)|(?<!\w)\d{4}[ -]?\d{6}[ -]?\d{5}(?!\w)"
ANY = f"(?:{EMAIL}|{DATE}|{IPV4}|{PHONE}|{SSN}|{IBAN}|{CARD})"


def _sql(text: str) -> str:
    return "r'" + text.replace("'", "\\'") + "'"


def feistel(left: str, right: str, a: str, b: str, key: str, tweak: str, back: bool = False) -> str:
    """SQL of a permutation of pairs (left below a, right below b): in turn each half moves by a keyed hash of the other.

    The hash is the leading 60 bits of SHA-256 over key, tweak, round and half, so equal values under one key and tweak
    stay equal and different ones stay different. back: the inverse.
    """
    f = f"cast(conv(left(sha2(concat_ws('|', '{key}', {tweak}, cast(i as string), cast(h as string)), 256), 15), 16, 10) as bigint)"
    on = lambda half: f.replace("cast(h as", f"cast({half} as")
    sign = "-" if back else "+"
    even = f"named_struct('l', pmod(s.l {sign} pmod({on('s.r')}, {a}), {a}), 'r', s.r)"
    odd = f"named_struct('l', s.l, 'r', pmod(s.r {sign} pmod({on('s.l')}, {b}), {b}))"
    turns = f"sequence({ROUNDS - 1}, 0, -1)" if back else f"sequence(0, {ROUNDS - 1})"
    return f"aggregate({turns}, named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> if(i % 2 = 0, {even}, {odd}))"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def permuted_digits(d: str, key: str, tweak: str, back: bool = False) -> str:
    """SQL: a digit string of up to 34 digits permuted among those of its length; an empty one stays, a single digit moves too."""
    n = f"cast(length({d}) div 2 as int)"
    p = lambda k: f"cast(pow(10, {k}) as bigint)"
    both = feistel(f"coalesce(cast(left({d}, {n}) as bigint), 0)", f"coalesce(cast(substring({d}, {n} + 1) as bigint), 0)", p(n), p(f"(length({d}) - {n})"), key, f"concat({tweak}, length({d}))", back)
    return _let("x", both, f"concat(if({n} = 0, '', lpad(cast(x.l as string), {n}, '0')), if({d} = '', '', lpad(cast(x.r as string), length({d}) - {n}, '0')))")


def luhn(d: str) -> str:
    """SQL: the check digit that makes the digit string d followed by it valid by Luhn."""
    at = f"cast(substring({d}, length({d}) - k, 1) as int)"
    return f"cast(pmod(10 - pmod(aggregate(sequence(0, length({d}) - 1), 0, (t, k) -> t + if(k % 2 = 0, {at} * 2 - if({at} > 4, 9, 0), {at})), 10), 10) as string)"


def refilled(form: str, digits: str) -> str:
    """SQL: form with its digits replaced in turn by those of digits."""
    return f"aggregate(split({form}, ''), named_struct('o', '', 'k', 1), (s, c) -> if(c rlike '[0-9]', named_struct('o', concat(s.o, substring({digits}, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k)), s -> s.o)"


def _day(m: str) -> str:
    iso = f"if({m} rlike '^[0-9]{{4}}-', {m}, concat(right({m}, 4), '-', substring({m}, 4, 2), '-', left({m}, 2)))"
    return f"datediff(try_cast({iso} as date), date'{FIRST_DAY}')"


def _email_part(c: str, key: str, back: bool) -> str:
    """SQL: the local part, lower-cased, with letters permuted among letters and digits among digits; runs of 12 at most go
    together, each under the place of its run, so equal parts stay equal."""
    run = f"regexp_extract_all({c}, r'[a-z]{{1,12}}|[0-9]{{1,12}}|[^a-z0-9]+', 0)"
    alphabet, codes = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"
    n = "cast(length(w) div 2 as int)"
    num = lambda t: f"coalesce(cast(conv(translate({t}, '{alphabet}', '{codes}'), 26, 10) as bigint), 0)"
    p = lambda k: f"cast(round(pow(26, {k})) as bigint)"
    both = feistel(num(f"left(w, {n})"), num(f"substring(w, {n} + 1)"), p(n), p(f"(length(w) - {n})"), key, "concat('mail', q, length(w))", back)
    word = lambda v, k: f"translate(lpad(lower(conv(cast({v} as string), 10, 26)), {k}, '0'), '{codes}', '{alphabet}')"
    letters = _let("y", both, f"concat(if({n} = 0, '', {word('y.l', n)}), {word('y.r', f'(length(w) - {n})')})")
    return f"array_join(transform({run}, (w, q) -> if(w rlike '^[a-z]', {letters}, if(w rlike '^[0-9]', {permuted_digits('w', key, chr(39) + 'mail' + chr(39) + ' || q', back)}, w))), '')"


def kind(m: str) -> str:
    """SQL: what a match is once validated, or null. Dates exist in the calendar and lie in the range, addresses have four
    parts up to 255 without leading zeros, cards pass Luhn, IBANs pass modulo 97, social security numbers have no zero or reserved group."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    iban = f"regexp_replace({m}, ' ', '')"
    mod97 = f"aggregate(split(concat(substring({iban}, 5), left({iban}, 4)), ''), 0, (t, c) -> pmod(if(c rlike '[A-Z]', t * 100 + ascii(c) - 55, t * 10 + coalesce(try_cast(c as int), 0)), 97))"
    full = lambda p: f"{m} rlike {_sql('^(?:' + p + ')$')}"
    return f"""case
      when {full(EMAIL)} then 'email'
      when {full(DATE)} then if({_day(m)} between 0 and {DAYS[0] * DAYS[1] - 1}, 'date', null)
      when {full(IPV4)} then if(forall(split({m}, '[.]'), o -> cast(o as int) <= 255 and (o = '0' or left(o, 1) <> '0')), 'ipv4', null)
      when {full(SSN)} then if({m} rlike r'^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)', 'ssn', null)
      when {full(PHONE)} then if(length({digits}) between 7 and 15, 'phone', null)
      when {full(IBAN)} then if(length({iban}) between 15 and 34 and {mod97} = 1, 'iban', null)
      when length({digits}) between 13 and 19 and {luhn(f"left({digits}, length({digits}) - 1)")} = right({digits}, 1) then 'card'
    end"""


def pseudonym(m: str, k: str, key: str, back: bool = False) -> str:
    """SQL: the pseudonym of match m of kind k, in the same format; back: the match of a pseudonym."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    body = permuted_digits("u", key, "'card'", back)
    card = _let("v", _let("u", f"left({digits}, length({digits}) - 1)", body), refilled(m, f"concat(v, {luhn('v')})"))
    start = _let("c", f"if({m} like '+%', length(regexp_extract({m}, r'^\\+[0-9]{{1,3}}', 0)) - 1, 0)", f"concat(left({digits}, c), {_let('u', f'substring({digits}, c + 1)', permuted_digits('u', key, chr(39) + 'phone' + chr(39), back))})")
    phone = _let("v", start, refilled(m, "v"))
    day = _let("x", feistel(f"{_day(m)} div {DAYS[1]}", f"{_day(m)} % {DAYS[1]}", str(DAYS[0]), str(DAYS[1]), key, "'date'", back), f"date_add(date'{FIRST_DAY}', cast(x.l * {DAYS[1]} + x.r as int))")
    date = _let("t", day, f"if({m} rlike '^[0-9]{{4}}-', date_format(t, 'yyyy-MM-dd'), date_format(t, if({m} like '%/%', 'dd/MM/yyyy', 'dd.MM.yyyy')))")
    octets = f"aggregate(split({m}, '[.]'), 0L, (t, o) -> t * 256 + cast(o as int))"
    ip = _let("x", feistel(f"{octets} div 65536", f"{octets} % 65536", "65536", "65536", key, "'ipv4'", back), "concat_ws('.', x.l div 256, x.l % 256, x.r div 256, x.r % 256)")
    # groups of a social security number: 898 areas, 99 groups, 9999 serials; all valid numbers and no others
    area = f"cast(left({m}, 3) as int)"
    ssn = _let("x", feistel(f"({area} - 1 - if({area} > 666, 1, 0)) * 99 + cast(substring({m}, 5, 2) as int) - 1", f"cast(right({m}, 4) as int) - 1", "88902", "9999", key, "'ssn'", back), _let("g", "x.l div 99 + 1", "concat(lpad(cast(g + if(g > 665, 1, 0) as string), 3, '0'), '-', lpad(cast(x.l % 99 + 1 as string), 2, '0'), '-', lpad(cast(x.r + 1 as string), 4, '0'))"))
    # the account part's digits of an IBAN move, letters stay, and the check digits are computed anew
    plain = f"regexp_replace({m}, ' ', '')"
    moved = _let("u", f"regexp_replace(substring({plain}, 5), '[^0-9]', '')", permuted_digits("u", key, "'iban'", back))
    bban = _let("v", moved, refilled(f"substring({plain}, 5)", "v"))
    check = f"lpad(cast(98 - aggregate(split(concat(w, left({plain}, 2), '00'), ''), 0, (t, c) -> pmod(if(c rlike '[A-Z]', t * 100 + ascii(c) - 55, t * 10 + coalesce(try_cast(c as int), 0)), 97)) as string), 2, '0')"
    new = _let("w", bban, f"concat(left({plain}, 2), {check}, w)")
    iban = _let("z", new, f"aggregate(split({m}, ''), named_struct('o', '', 'k', 1), (s, c) -> if(c = ' ', named_struct('o', concat(s.o, c), 'k', s.k), named_struct('o', concat(s.o, substring(z, s.k, 1)), 'k', s.k + 1)), s -> s.o)")
    mail = _let("p", f"lower(regexp_extract({m}, '^[^@]+', 0))", f"concat({_email_part('p', key, back)}, regexp_extract({m}, '@.*$', 0))")
    return f"case {k} when 'card' then {card} when 'phone' then {phone} when 'date' then {date} when 'ipv4' then {ip} when 'ssn' then {ssn} when 'iban' then {iban} when 'email' then {mail} else {m} end"


def pseudonymised(docs: DataFrame, key: str, column: str = "text", back: bool = False) -> DataFrame:
    """docs with the text's validated personal numbers, dates and addresses replaced, and pii_found, an array of
    (kind, length) in order of place.

    Each value is permuted within its format under the key, so it is the same in all documents, and back undoes it (for
    mail addresses up to letter case). Matches that fail validation stay. Null and empty texts stay and find nothing. Equal
    rows give equal rows. No rows: none. Other columns are carried along, whatever their names; one named pii_found is
    replaced. Only a digest of the key is in the plan.
    """
    secret = hashlib.sha256(key.encode()).hexdigest()
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{column}`").alias("t"))
    hit = F.col("t").rlike("[0-9]") | F.col("t").contains("@")
    d = d.withColumn("parts", F.when(hit, F.expr(f"regexp_extract_all(t, {_sql(ANY)}, 0)")))
    some = F.size("parts") > 0
    d = d.withColumn("new", F.when(some, F.expr(f"transform(parts, m -> {_let('k', kind('m'), 'named_struct(' + repr('k') + ', k, ' + repr('n') + ', length(m), ' + repr('t') + ', ' + pseudonym('m', 'k', secret, back) + ')')})")))
    # pieces between the matches and the matches themselves take turns
    d = d.withColumn("between", F.when(some, F.expr(f"split(t, {_sql(ANY)}, -1)")))
    joined = F.expr("array_join(transform(between, (b, i) -> concat(b, coalesce(get(new, i).t, ''))), '')")
    text = F.when(some, joined).otherwise(F.col("t")).alias(column)
    found = F.coalesce(F.expr("transform(filter(new, x -> x.k is not null), x -> struct(x.k as kind, x.n as length))"), F.expr("cast(array() as array<struct<kind: string, length: int>>)"))
    return d.select(*[text if c == column else F.col(f"row.`{c}`") for c in docs.columns if c != "pii_found"], found.alias("pii_found"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms under a key of the given tables, and the numbers of values by kind."""
    d = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key="given tables")
    kinds = [F.expr(f"size(filter(pii_found, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in ("email", "date", "ipv4", "phone", "ssn", "iban", "card")]
    return d.select("doc_id", *kinds, "text")
