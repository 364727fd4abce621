"""Format-preserving pseudonyms of personal numbers and dates, with built-in expressions only.

Validated values are permuted by a keyed Feistel network within the set of values of their format, so that equal
values get equal pseudonyms in all documents, different ones different ones, and a card number stays one that checks.
A network's halves are added to keyed SHA-256 values modulo the halves' own ranges, which keeps any product of two
ranges. Addresses and secrets have no fixed set of values; they get keyed digests of the same kind.

No pattern can tell whether check digits are right. The account and card numbers that check are therefore looked up first, from
every place where one can begin, and a text's pattern names them: what only looks like one takes nothing from other values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subweave.llm.shared import column

ROUNDS = 8

# what may be a value; each is validated before it is replaced. Account, card and telephone numbers: below
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,256}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})*\.[A-Za-z]{2,}",
    "secret": r"(?i:token|secret|api[_-]?key|access[_-]?key|password|passwd)[ \t]*[=:][ \t]*[\x22']?[A-Za-z0-9+/_\-]{16,}",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "date": r"(?<![\d/.\-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/\-]|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
}
# a telephone number's digits after its country's, from and to, for countries where they are known; elsewhere 8 to 15 digits in all
_PHONE_DIGITS = {(10, 10): "1|7|52|63|90|91|92", (9, 10): "44|81|84", (10, 11): "55|86", (9, 9): "27|33|34|31|40|41|48|61|212|213|351|380|420|421|966", (8, 9): "32|36|66|886|971|972", (8, 8): "45|47|65|216|371|370|502|503|504|505|506|507|852", (7, 9): "46|353"}
_PHONE = r"\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)"


def _some_digits(least: int, most: int) -> str:
    """A pattern of digits with little between them, written out, as looking behind allows no repeated groups."""
    one = r"[ .\-()]{0,2}\d"
    return one * least + f"(?:{one}" * (most - least) + ")?" * (most - least)


_OF_COUNTRIES = "|".join(rf"\+(?:{countries}){_some_digits(*n)}" for n, countries in _PHONE_DIGITS.items())
_PATTERNS["phone"] = rf"{_PHONE}(?<={_OF_COUNTRIES})|{_PHONE}(?<=\+\d{_some_digits(7, 14)})|(?<!\d)(?:\([2-9]\d{{2}}\) ?|[2-9]\d{{2}}[\-. ])[2-9]\d{{2}}[\-. ]\d{{4}}(?!\d)"

# fixed values: the country codes of one and of two digits; all others have three
_ONE_DIGIT, _TWO_DIGITS = "^[17]", "^(2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"

# places where an account or card number can begin, with the longest one from there as the first group
_IBANS = r"(?<![A-Za-z0-9])(?=([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9]))"
_CARDS = r"(?<!\d)(?=(\d{4}([ -])\d{4}\2\d{4}\2\d{4}|\d{4}([ -])\d{6}\3\d{5}|\d{13,19})(?!\d))"
_IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _keyed(key: str, tag: str, i: str, x: str, below: str) -> str:
    return f"pmod(cast(conv(substr(sha2(concat_ws(':', {key}, {tag}, {i}, {x}), 256), 1, 15), 16, 10) as bigint), {below})"


def feistel(key: str, tag: str, left: str, right: str, a: str, b: str) -> str:
    """SQL for struct(l, r): the permutation of pairs below (a, b) that key and tag name. All arguments are SQL."""
    start = f"named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint))"
    even = f"named_struct('l', (s.l + {_keyed(key, tag, 'i', 's.r', a)}) % {a}, 'r', s.r)"
    odd = f"named_struct('l', s.l, 'r', (s.r + {_keyed(key, tag, 'i', 's.l', b)}) % {b})"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> if(i % 2 = 0, {even}, {odd}))"


def _permuted_digits(key: str, tag: str, d: str) -> str:
    """SQL: a string of 2 to 30 digits permuted among the strings of its length."""
    h, rest = f"(length({d}) div 2)", f"(length({d}) - length({d}) div 2)"
    a, b = f"cast(power(10, {h}) as bigint)", f"cast(power(10, {rest}) as bigint)"
    pair = feistel(key, f"concat({tag}, length({d}))", f"substr({d}, 1, {h})", f"substr({d}, {h} + 1)", a, b)
    return f"element_at(transform(array({pair}), q -> concat(lpad(cast(q.l as string), {h}, '0'), lpad(cast(q.r as string), {rest}, '0'))), 1)"


def _permuted_number(key: str, tag: str, d: str) -> str:
    """SQL: a string of digits permuted among those of its length that begin with 0, or among those that don't."""
    h = f"(length({d}) div 2)"
    some = f"cast(power(10, {h} - 1) as bigint)"
    zero = f"startswith({d}, '0')"
    left, a, b = f"cast(substr({d}, 1, {h}) as bigint) - if({zero}, 0, {some})", f"(if({zero}, 1, 9) * {some})", f"cast(power(10, length({d}) - {h}) as bigint)"
    pair = feistel(key, f"concat_ws(':', {tag}, length({d}), {zero})", left, f"substr({d}, {h} + 1)", a, b)
    return f"if(length({d}) < 2, {d}, {_let(pair, 'q', f'concat(lpad(cast(q.l + if({zero}, 0, {some}) as string), {h}, {_ZERO}), lpad(cast(q.r as string), length({d}) - {h}, {_ZERO}))')})"


_ZERO = "'0'"


def _refilled(m: str, d: str) -> str:
    """SQL: m with its digits replaced by those of d, in order."""
    return f"aggregate(split({m}, ''), named_struct('o', '', 'k', 1, 'd', {d}), (z, c) -> if(c rlike '^[0-9]$', named_struct('o', concat(z.o, substr(z.d, z.k, 1)), 'k', z.k + 1, 'd', z.d), named_struct('o', concat(z.o, c), 'k', z.k, 'd', z.d)), z -> z.o)"


def _luhn(d: str) -> str:
    """SQL: the sum of digits with every second one, counted from the right, doubled."""
    return f"aggregate(split(reverse({d}), ''), named_struct('t', 0, 'k', 0), (z, c) -> named_struct('t', z.t + if(z.k % 2 = 0, coalesce(try_cast(c as int), 0), element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), coalesce(try_cast(c as int), 0) + 1)), 'k', z.k + 1), z -> z.t)"


def _mod97(s: str) -> str:
    """SQL: letters and digits read as one number (A is 10), modulo 97."""
    return f"aggregate(split({s}, ''), 0, (z, c) -> case when c rlike '^[0-9]$' then (z * 10 + cast(c as int)) % 97 when c rlike '^[A-Z]$' then (z * 100 + ascii(c) - 55) % 97 else z end)"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def pseudonym(m: str, key: str) -> str:
    """SQL for the pseudonym of the match m, or m itself where it isn't valid."""
    email = f"concat('user-', substr(sha2(concat_ws(':', {key}, 'email', lower({m})), 256), 1, 16), '@mail.invalid')"
    value = f"regexp_extract({m}, '[A-Za-z0-9+/_-]+$', 0)"
    secret = _let(value, "v", f"concat(substr({m}, 1, length({m}) - length(v)), substr(concat(sha2(concat_ws(':', {key}, 'secret', v), 256), sha2(concat_ws(':', {key}, 'more', v), 256), repeat('0', greatest(0, length(v) - 128))), 1, length(v)))")
    octets = f"transform(split({m}, '[.]'), o -> cast(o as bigint))"
    ip = _let(octets, "o4", _let(feistel(key, "'ip'", "o4[0] * 256 + o4[1]", "o4[2] * 256 + o4[3]", "65536L", "65536L"), "q", "concat_ws('.', q.l div 256, q.l % 256, q.r div 256, q.r % 256)"))
    parts = f"split({m}, '[/.-]')"
    # year first, or day and month first (month and day where only that makes a date); years 1700 to 2099 are 189 x 773 days
    iso = "try_to_date(concat_ws('-', p[0], lpad(p[1], 2, '0'), lpad(p[2], 2, '0')), 'yyyy-MM-dd')"
    dmy = "try_to_date(concat_ws('-', p[2], lpad(p[1], 2, '0'), lpad(p[0], 2, '0')), 'yyyy-MM-dd')"
    mdy = "try_to_date(concat_ws('-', p[2], lpad(p[0], 2, '0'), lpad(p[1], 2, '0')), 'yyyy-MM-dd')"
    first = "length(p[0]) = 4"
    form = f"case when {first} then 'Y' when {dmy} is not null then 'D' when contains({m}, '/') then 'M' end"
    day = f"datediff(case when {first} then {iso} when {dmy} is not null then {dmy} when contains({m}, '/') then {mdy} end, date'1700-01-01')"
    moved = _let(feistel(key, "'date'", "n div 773", "n % 773", "189L", "773L"), "q", "date_add(date'1700-01-01', cast(q.l * 773 + q.r as int))")
    sep = f"substr(regexp_extract({m}, '[/.-]', 0), 1, 1)"
    # days and months have two digits, unless one of them stands there with a single digit
    short = "exists(p, x -> length(x) = 1)"
    month, date_day = f"if({short}, cast(month(t) as string), date_format(t, 'MM'))", f"if({short}, cast(day(t) as string), date_format(t, 'dd'))"
    shown = f"case f when 'Y' then concat_ws({sep}, year(t), {month}, {date_day}) when 'D' then concat_ws({sep}, {date_day}, {month}, year(t)) else concat_ws({sep}, {month}, {date_day}, year(t)) end"
    date = _let(parts, "p", _let(form, "f", _let(day, "n", f"if(n between 0 and 146096, {_let(moved, 't', shown)}, {m})")))
    body = _permuted_digits(key, "'card'", "substr(d, 1, length(d) - 1)")
    card = _let(_digits(m), "d", f"if({_luhn('d')} % 10 = 0 and not d rlike '^0+$', {_refilled(m, _let(body, 'e', _let(_luhn("concat(e, '0')"), 'u', 'concat(e, cast(pmod(10 - u % 10, 10) as string))')))}, {m})")
    # the country's code stays; a North American number, with or without it, is permuted among such numbers
    kept = f"if(startswith({m}, '+'), case when d rlike '{_ONE_DIGIT}' then 1 when d rlike '{_TWO_DIGITS}' then 2 else 3 end, 0)"
    american = feistel(key, "'american'", "(cast(substr(e, 1, 3) as bigint) - 200) * 800 + cast(substr(e, 4, 3) as bigint) - 200", "substr(e, 7)", "640000L", "10000L")
    american = _let(american, "q", "concat(q.l div 800 + 200, q.l % 800 + 200, lpad(cast(q.r as string), 4, '0'))")
    national = f"if(substr(d, 1, k) in ('', '1') and e rlike '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$', {american}, {_permuted_number(key, "concat('phone:', substr(d, 1, k))", 'e')})"
    phone = _let(_digits(m), "d", f"if(length(d) between 8 and 15, {_let(kept, 'k', _let('substr(d, k + 1)', 'e', _refilled(m, f'concat(substr(d, 1, k), {national})')))}, {m})")
    area = "cast(substr(d, 1, 3) as bigint)"
    ssn_pair = feistel(key, "'ssn'", f"if({area} > 666, {area} - 2, {area} - 1)", "(cast(substr(d, 4, 2) as bigint) - 1) * 9999 + cast(substr(d, 6, 4) as bigint) - 1", "898L", "989901L")
    ssn_text = "concat(lpad(cast(if(q.l >= 665, q.l + 2, q.l + 1) as string), 3, '0'), '-', lpad(cast(q.r div 9999 + 1 as string), 2, '0'), '-', lpad(cast(q.r % 9999 + 1 as string), 4, '0'))"
    ssn = _let(_digits(m), "d", f"if({area} between 1 and 899 and {area} <> 666 and substr(d, 4, 2) <> '00' and substr(d, 6, 4) <> '0000', {_let(ssn_pair, 'q', ssn_text)}, {m})")
    account = "substr(w, 5)"
    own = _digits(account)
    other = f"if(length({own}) between 2 and 30, {_let(_refilled(account, _permuted_digits(key, chr(39) + 'iban' + chr(39), own)), 'g', 'concat(substr(w, 1, 2), lpad(cast(98 - ' + _mod97('concat(g, substr(w, 1, 2), ' + chr(39) + '00' + chr(39) + ')') + ' as string), 2, ' + chr(39) + '0' + chr(39) + '), g)')}, w)"
    blanks = f"aggregate(split({m}, ''), named_struct('o', '', 'k', 1), (z, c) -> if(c = ' ', named_struct('o', concat(z.o, c), 'k', z.k), named_struct('o', concat(z.o, substr(y, z.k, 1)), 'k', z.k + 1)), z -> z.o)"
    iban = _let(f"replace({m}, ' ', '')", "w", f"if({_is_iban('w')}, {_let(other, 'y', blanks)}, {m})")
    return f"""case
      when contains({m}, '@') then {email}
      when {m} rlike '^(?i:token|secret|api|access|password|passwd)' then {secret}
      when {m} rlike '^[A-Z]' then {iban}
      when {m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then if(forall({octets}, o -> o <= 255), {ip}, {m})
      when {m} rlike '^([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}|[0-9]{{1,2}}([/.])[0-9]{{1,2}}[/.][0-9]{{4}})$' then {date}
      when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {ssn}
      when {m} rlike '^[0-9]' and length({_digits(m)}) >= 13 then {card}
      when {m} rlike '^[+(0-9]' then {phone}
      else {m} end"""


def _is_iban(w: str) -> str:
    return f"{_mod97(f'concat(substr({w}, 5), substr({w}, 1, 4))')} = 1"


def _iban_in(m: str) -> str:
    """SQL: the account number that m begins with, or null: of its country's length, else all of m (where the country is unknown the longest beginning) that checks."""
    lengths = ", ".join(f"'{c}', {n}" for n, countries in _IBAN_LENGTHS.items() for c in countries.split())
    ends = f"transform(sequence(1, size(split({m}, ' '))), k -> array_join(slice(split({m}, ' '), 1, k), ' '))"
    size = "length(replace(v, ' ', ''))"
    likely = f"{size} >= 12 and (v = {m} or coalesce({size} = n, true))"
    checks = _let("replace(v, ' ', '')", "w", _is_iban("w"))
    best = f"array_max(transform(filter({ends}, v -> {likely} and {checks}), v -> named_struct('known', coalesce({size} = n, false), 'size', {size}, 'v', v))).v"
    return _let(f"try_element_at(map({lengths}), substr({m}, 1, 2))", "n", best)


def text_pattern(text: str) -> str:
    """SQL for the pattern of a text's values: fixed ones, and the account and card numbers in it that check, longest first."""
    # blanks, letters, digits and hyphens stand for themselves
    named = lambda values: f"array_join(array_sort(array_distinct({values}), (a, b) -> case when length(a) <> length(b) then length(b) - length(a) when a < b then -1 when a > b then 1 else 0 end), '|')"
    ibans = f"filter(transform(regexp_extract_all({text}, {_quoted(_IBANS)}, 1), m -> {_iban_in('m')}), v -> v is not null)"
    cards = f"filter(regexp_extract_all({text}, {_quoted(_CARDS)}, 1), m -> {_let(_digits('m'), 'd', _luhn('d') + ' % 10 = 0 and not d rlike ' + _quoted('^0+$'))})"
    iban = _let(named(ibans), "x", f"if(x = '', '', concat({_quoted('(?<![A-Za-z0-9])(?:')}, x, {_quoted(')(?![A-Za-z0-9])|')}))")
    card = _let(named(cards), "x", f"if(x = '', '', concat({_quoted('(?<![0-9])(?:')}, x, {_quoted(')(?![0-9])|')}))")
    fixed = lambda *names: _quoted("".join(_PATTERNS[n] + "|" for n in names))
    return f"concat({fixed('email', 'secret')}, {iban}, {fixed('ip', 'date')}, {card}, {_quoted(_PATTERNS['phone'] + '|' + _PATTERNS['ssn'])})"


def _worth_a_look(text: Column) -> Column:
    """Whether a text can hold a value at all; a cheap test for the many that can't."""
    return text.rlike(r"[0-9]|@") | text.rlike(r"(?i)(?:token|secret|key|passw)")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the personal values in the text replaced; all other columns as they were.

    Replaced are: card numbers that pass their check digit, telephone numbers (with a leading + or of North American form),
    IPv4 addresses, dates of the years 1700 to 2099, social security and bank account numbers that are valid, e-mail
    addresses, and secrets after a word such as `token =`. Numbers that aren't valid stay as they are.
    key: secret text; the same key gives the same pseudonyms. It reaches the tasks as a scalar subquery's value, so it
    stands in no plan or log. count_col: also the number of values replaced, int; it takes the place of a column of that name.
    Null texts stay null (count 0), empty ones empty; rows are neither dropped nor merged.
    """
    names = docs.columns
    text = column(text_col)
    pattern = "__pattern_of_values"
    quoted = "`" + text_col.replace("`", "``") + "`"
    matches = f"regexp_extract_all({quoted}, {pattern}, 0)"
    # one array of struct(what was there, what stands there now), computed once for a text
    held = "__key_of_values"
    pairs = F.expr(f"transform({matches}, m -> named_struct('m', m, 'p', {pseudonym('m', held)}))")
    none = F.expr("cast(array() as array<struct<m:string,p:string>>)")
    place, gaps = "__pairs_of_values", "__texts_between"
    out = docs.withColumn(held, docs.sparkSession.createDataFrame([(key,)], "key string").scalar())
    out = out.withColumn(pattern, F.when(_worth_a_look(text), F.expr(text_pattern(quoted))))
    out = out.withColumn(place, F.when(_worth_a_look(text), pairs).otherwise(none))
    out = out.withColumn(gaps, F.when(F.size(place) > 0, F.expr(f"split({quoted}, {pattern}, -1)")))
    new = F.when(F.size(place) > 0, F.expr(f"array_join(transform(sequence(0, size({gaps}) - 1), k -> concat({gaps}[k], coalesce(get({place}, k).p, ''))), '')")).otherwise(text)
    columns = [new.alias(c) if c == text_col else column(c) for c in names if not count_col or c.lower() != count_col.lower()]
    if count_col:
        columns.append(F.coalesce(F.size(F.filter(place, lambda x: x["m"] != x["p"])), F.lit(0)).alias(count_col))
    return out.select(*columns)
