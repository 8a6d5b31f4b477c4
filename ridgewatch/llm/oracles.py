"""SQL twins (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

from ridgewatch.llm import license_scan, secrets

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scan() -> str:
    """Spans from what lies between matches: pieces and matches alternate."""
    per_rule = []
    for place, rule in enumerate(secrets.RULES):
        keep = f"regexp_matches(m, {_quoted(rule.keep)})" if rule.keep else "true"
        per_rule.append(
            f"select rid, {place} as place, '{rule.name}' as kind, ms, gs, {keep.replace('(m,', '(ms[i],')} as stays, i from "
            f"(select rid, regexp_extract_all(t, {_quoted(rule.pattern)}) as ms, string_split_regex(t, {_quoted(rule.pattern)}) as gs from d) x, "
            "unnest(range(1, len(ms) + 1)) u(i)"
        )
    size = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
    return f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
      p as ({' union all '.join(per_rule)}),
      s as (select rid, place, kind, {size.format('gs[1:i]')} + {size.format('ms[1:i-1]')} as a, length(ms[i]) as n from p where stays),
      j as (select rid, count_if(place = 0) as n_assign, count_if(place = 1) as n_access, count_if(place = 2) as n_hex,
        string_agg(kind || ':' || a::bigint || ':' || (a + n)::bigint, ',' order by a, place) filter (place < 3) as base,
        string_agg(kind || ':' || a::bigint || ':' || (a + n)::bigint, ',' order by a, place) as spans from s group by rid)
      select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
        sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, sha256(t) as blob from d left join j using (rid)"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (
    "list_sum(list_transform(range(1, length(dg) + 1), lambda i: case when i % 2 = 1 then cast(substr(reverse(dg), i, 1) as integer) "
    "else 2 * cast(substr(reverse(dg), i, 1) as integer) - 9 * (cast(substr(reverse(dg), i, 1) as integer) > 4)::integer end)) % 10 = 0"
).replace("dg", _DIGITS)
_OCTETS = (
    "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) < 4 "
    "and coalesce(try_cast(ltrim(x, '0') as integer), 0) <= 255))"
)
_CODE = "regexp_replace(regexp_replace(m, '^(IBAN|iban|Iban)[ :]*', ''), ' ', '', 'g')"
_MOD97 = (
    "list_reduce(list_prepend(0, list_transform(string_split(substr(cd, 5) || substr(cd, 1, 4), ''), "
    "lambda c: position(c in '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ') - 1)), lambda a, b: (a * (case when b > 9 then 100 else 10 end) + b) % 97) = 1"
).replace("cd", _CODE)
#: kind, pattern, what is cut off a match at its start and end, and which matches m stay.
_PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "0", "0", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "0", "0", _OCTETS),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", "0", "0", f"case when length({_DIGITS}) between 16 and 19 then {_LUHN} else false end"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "0", "0", f"length({_DIGITS}) between 8 and 15"),
    ("login", r"://[A-Za-z0-9._~!$&'()*+,;=:%-]+@", "3", "1", "position(':' in substr(m, 4)) > 0"),
    (
        "iban", r"(?:IBAN|iban|Iban)[ :]*[A-Z] ?[A-Z] ?[0-9] ?[0-9](?: ?[A-Z0-9]){11,30}",
        "length(m) - length(regexp_replace(m, '^(IBAN|iban|Iban)[ :]*', ''))", "0", _MOD97,
    ),
)


def personal_data() -> str:
    parts = []
    for place, (kind, pattern, head, tail, keep) in enumerate(_PERSONAL):
        quoted = _quoted(pattern)
        parts.append(
            f"select rid, place, kind, a + ({head}) as a, b - {tail} as b from (select rid, {place} as place, '{kind}' as kind, ms[i] as m, "
            "coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as a, "
            "coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0) as b "
            f"from (select rid, regexp_extract_all(t, {quoted}) as ms, string_split_regex(t, {quoted}) as gs from d) x, unnest(range(1, len(ms) + 1)) u(i)) y where {keep}"
        )
    one = "kind || ':' || a::bigint || ':' || b::bigint"
    counts = ", ".join(f"count_if(place = {k}) as n_{kind}" for k, (kind, *_) in enumerate(_PERSONAL[:4]))
    filled = ", ".join(f"coalesce(n_{kind}, 0) as n_{kind}" for kind, *_ in _PERSONAL[:4])
    return f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents), s as ({' union all '.join(parts)}),
      j as (select rid, {counts}, string_agg({one}, ',' order by place, a) filter (place < 4) as base, string_agg({one}, ',' order by place, a) as spans from s group by rid)
      select doc_id, {filled}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join j using (rid)"""


NGRAM_JOIN = rf"""with recursive w as (select doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') as ws from documents),
  s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) end as sh from w),
  u as (select doc_id, len(sh) as n, unnest(sh) as g from s),
  p as (select a.doc_id as x, b.doc_id as y from u a join u b on a.g = b.g and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  r as (select doc_id as a, doc_id as b from s union select r.a, p.y from r join p on r.b = p.x),
  c as (select a, min(b) as least from r group by a)
  select doc_id, len(sh)::bigint as n_shingles, least as component_id from s join c on a = doc_id"""

_ESCAPED = r"regexp_replace({0}, '(\\*)(<turn>|</turn>|###)', '\\\1\2', 'g')"

CHAT_FORMAT = rf"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 21)::bigint as formatted_chars from t group by conv_id"""

_ITEM_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""with d as (select row_number() over () as rid, doc_id, {_ITEM_WORDS} as ws from documents),
  b as (select distinct item_id, {_ITEM_WORDS} as ws from benchmark where item_id is not null),
  bw as (select distinct item_id, least(13, len(ws)) as l, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') as s
    from b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) t(i) where len(ws) > 0),
  ls as (select distinct l from bw),
  dw as (select rid, i, l, array_to_string(ws[i:i + l - 1], ' ') as s from d, ls, unnest(range(1, len(ws) - l + 2)) t(i)),
  m as (select rid, i, dw.l, item_id from dw join bw on dw.s = bw.s and dw.l = bw.l),
  h as (select rid, count(distinct p) as n_hit from m, unnest(range(i, i + l)) t(p) group by rid),
  k as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items
    from (select distinct rid, cast(item_id as varchar) as item from m) group by rid)
  select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated from d left join h using (rid) left join k using (rid)"""


def licence_scan() -> str:
    listed = ", ".join(f"({_quoted(name)}, {number}, {_quoted(text)})" for name, number, text in license_scan.templates())
    cue, names = _quoted(license_scan.CUES), _quoted(license_scan.NAMES)
    terms = "regexp_extract_all(" + _LOWER + ", '[a-z0-9]+')"
    return rf"""with f as (select row_number() over () as rid, doc_id, concat_ws('/', coalesce(source, ''), cast(doc_id // 50 as varchar), coalesce(lang, ''), cast(doc_id as varchar)) as path,
      text from documents),
    g as (select rid, text, regexp_extract(text, {_quoted(license_scan.SPDX)}, 1) as tag from f where regexp_matches(text, {cue})),
    c as (select distinct rid, line, whole_ from (
      select rid, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {cue}))) as line, false as whole_ from g union all
      select rid, unnest(list_filter(string_split_regex(text, {_quoted(license_scan.PARAGRAPHS)}), lambda x: regexp_matches(x, {cue}) and contains(x, chr(10)))), false from g union all
      select rid, text, true from g)),
    t as (select * from (values {listed}) v(license, number, line)),
    n as (select line, count(*) as times from c group by line),
    tf as (select line, times, term, count(*) as tf from (select line, times, unnest({terms.format('line')}) as term from n) group by all),
    own as (select license, number, term, count(*) as tf from (select license, number, unnest({terms.format('line')}) as term from t) group by all),
    df as (select term, sum(times) as df from (select term, times from tf union all select term, 1 from own) group by term),
    total as (select coalesce(sum(times), 0) + {len(license_scan.templates())} as total from n),
    idf as (select term, ln((1 + total)::double / (1 + df)) + 1 as idf from df, total),
    a as (select line, term, tf * idf as w from tf join idf using (term)), z as (select license, number, term, tf * idf as v from own join idf using (term)),
    na as (select line, sqrt(sum(w * w)) as na from a group by line), nz as (select license, number, sqrt(sum(v * v)) as nz from z group by license, number),
    cs as (select line, license, round(dot / (na * nz), 6) as sim from (select line, license, number, sum(w * v) as dot from a join z using (term) group by line, license, number) join na using (line) join nz using (license, number)),
    best as (select line, license, sim from (select *, row_number() over (partition by line order by sim desc, license) as r from cs where sim >= {license_scan.THRESHOLD}) where r = 1),
    fo as (select rid, license, sim, only_ from (select rid, license, sim, bool_or(whole_) over (partition by rid) as only_,
      row_number() over (partition by rid order by sim desc, license) as r from c join best using (line)) where r = 1),
    o as (select rid, case when tag <> '' then tag else license end as own_license, case when tag <> '' then 1.0::double else sim end as similarity, only_
      from g left join fo using (rid) where tag <> '' or license is not null),
    nm as (select f.doc_id, path, own_license, similarity, own_license is not null and (coalesce(only_, false) or regexp_matches(regexp_replace(path, '^.*/', ''), {names})) as only_,
      regexp_replace(path, '/[^/]*$', '') as place from f left join o using (rid)),
    rd as (select place as dir, own_license as rule from (select *, row_number() over (partition by place order by similarity desc, own_license) as r from nm where only_) where r = 1),
    pl as (select distinct place, string_split(place, '/') as parts from nm),
    ru as (select place, dir, rule from (select place, dir, rule, row_number() over (partition by place order by k desc) as r
      from (select place, k, array_to_string(parts[1:k], '/') as anc from pl, unnest(range(0, len(parts) + 1)) u(k)) join rd on dir = anc) where r = 1)
    select doc_id, path, own_license, similarity, only_ as is_license_file, coalesce(own_license, rule) as license,
      case when own_license is null then dir end as inherited_from from nm left join ru using (place)"""


ORACLES = {
    "op1_secret_scan": secret_scan(),
    "op2_pii": personal_data(),
    "op3_ngram_join": NGRAM_JOIN,
    "op4_chat_format": CHAT_FORMAT,
    "op7_decontamination": DECONTAMINATION,
    "op9_license_scan": licence_scan(),
}
