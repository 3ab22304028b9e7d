"""Oracle SQL (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

#: The article of a page, by plain patterns: what the line-block distribution must find where the page marks its article.
OP3 = r"""with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(?:</article>|$)', 1) as x from pages),
t as (select page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(x, '</?(?:h1|p|br)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) as x from a),
u as (select page_id, url, replace(replace(x, '&quot;', '"'), '&amp;', '&') as text from t)
select page_id, url, text, length(text) as n_chars from u"""

#: All pairs that share a shingle, their weighted Jaccard index, and components by the least reachable document.
OP7 = r"""with recursive w as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\f\v]+'), lambda x: x <> '') as words, md5(coalesce(text, '')) as digest from documents),
c as (select digest, any_value(words) as words from w group by digest),
s0 as (select digest, unnest(case when len(words) = 0 then [] when len(words) <= 5 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as s from c),
s as (select digest, md5(s) as s, count(*) as n from s0 group by all),
t as (select digest, sum(n) as total from s group by digest),
shared as (select a.digest as x, b.digest as y, sum(least(a.n, b.n)) as m from s a join s b on a.s = b.s and a.digest < b.digest group by all),
links as (select x, y from shared join t a on a.digest = x join t b on b.digest = y where m >= 0.8 * (a.total + b.total - m)),
e as materialized (select x, y from links union select y, x from links),
reach as (select digest as a, digest as b from c where digest in (select x from e) union select r.a, e.y from reach r join e on e.x = r.b),
root as (select a as digest, min(b) as root from reach group by a),
named as (select doc_id, w.digest, coalesce(r.root, w.digest) as root from w left join root r using (digest)),
g as (select root, min(doc_id) as group_id, count(*) as group_size from named group by root)
select doc_id, group_id, group_size, doc_id = group_id as keep from named join g using (root)"""

#: Every string of 200 bytes of every document, counted by digest.
OP8 = r"""with d as materialized (select doc_id, encode(coalesce(text, '')) as b from documents),
n as materialized (select doc_id, b, octet_length(b) as n from d),
w as (select doc_id, s, md5(b[s:s + 199]) as h from (select doc_id, b, unnest(range(1, n - 198)) as s from n where n >= 200)),
r as (select doc_id, s from w join (select h from w group by h having count(*) > 1) using (h)),
i as (select doc_id, s, coalesce(s > lag(s) over (partition by doc_id order by s) + 200, true) as fresh from r),
j as (select doc_id, s, sum(cast(fresh as int)) over (partition by doc_id order by s) as run from i),
spans as (select doc_id, run, min(s) as a, max(s) + 200 as z from j group by doc_id, run),
k as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 1) as kept_from from spans),
parts as (select doc_id, kept_from as f, a as t from k union all select doc_id, max(z), null from spans group by doc_id),
kept as (select doc_id, string_agg(hex(b[f:coalesce(t, n + 1) - 1]), '' order by f) as h from parts join n using (doc_id) group by doc_id),
c as (select doc_id, sum(z - a) as removed, count(*) as spans from spans group by doc_id)
select n.doc_id, n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans,
  sha256(case when removed is null then b else unhex(h) end) as kept_sha256
from n left join c using (doc_id) left join kept using (doc_id)"""

#: All phrases of one to four words of all pieces, counted as they are.
OP11 = r"""with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
p as (select lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as materialized (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda y: y <> '') as ws from p),
g as (select lang, len, unnest(list_transform(range(1, len(ws) - len + 2), lambda i: array_to_string(ws[i:i + len - 1], ' '))) as phrase from w, (select unnest([1, 2, 3, 4]) as len)),
f as materialized (select lang, len, phrase, count(*) as f from g group by all having count(*) >= 30),
t as (select lang, sum(len(ws)) as n from w group by lang),
c as (select lang, phrase, f as a, len, string_split(phrase, ' ') as ws from f where len > 1),
k as (select c.*, unnest(range(1, len)) as k from c),
s as (select k.lang, k.phrase, a, k.len, k, l.f as l, r.f as r, cast(cast(2000000 as hugeint) * a // (cast(l.f as hugeint) + r.f) as bigint) as score from k
  join f l on l.lang = k.lang and l.phrase = array_to_string(ws[1:k], ' ') join f r on r.lang = k.lang and r.phrase = array_to_string(ws[k + 1:], ' ')),
b as (select lang, phrase, a, arg_min(l, (score, k)) as l, arg_min(r, (score, k)) as r, min(score) as score from s group by lang, phrase, a),
i as (select lang, a as f, ws, unnest(range(2, len)) as k, len from c),
j as (select lang, array_to_string(ws[o:o + k - 1], ' ') as phrase, max(f) as f from (select *, unnest(range(1, len - k + 2)) as o from i) group by all),
o as (select b.* from b left join j using (lang, phrase) where j.f is null or 100 * j.f < 80 * a),
r as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from o)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from r join t using (lang) where rank <= 2000"""

#: Normalised texts grouped as they are.
OP12 = r"""with t as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as x from documents),
g as (select x, arg_min(doc_id, (-n, doc_id)) as keep_id, max(n) as most, count(*) as group_size from t group by x)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id and n = most as kept, sha256(x) as text_sha256 from t join g using (x)"""

def _op13() -> str:
    """All ways by turn: for each role that may come last (or none), the cheapest and least audit so far with its repaired turns."""
    step = lambda q, cost, audit, lines="": f"case when {q} is not null then {{'c': {q}.c + {cost}, 't': {q}.t || {audit}, 'x': {q}.x || {lines or repr('')}}} end"  # noqa: E731
    line = lambda role, text: f"chr(10) || {role} || ':' || {text}"  # noqa: E731

    def stay(q: str, r: str, put: str = "") -> str:
        kept = f"(i = '{r}')"
        name = {"u": "user", "a": "assistant", "s": "system"}
        lines = (line(f"'{name[put]}'", "''") + " || " if put else "") + line(f"(case when {kept} then role else '{name[r]}' end)", "text")
        letters = f"'{'I' if put else ''}' || (case when {kept} then 'K' else 'R' end)"
        may = kept if r == "s" else "true"
        return f"case when {may} and fault not in ('blank', 'duplicate') then {step(q, f'(case when fault = {chr(39)}truncated{chr(39)} then 3 else 0 end) + (case when {kept} then 0 else 3 end) + {3 * len(put)}', letters, lines)} end"

    gone = lambda q: step(q, 4, "'D'")  # noqa: E731
    best = lambda *ways: f"list_min([{', '.join(ways)}])"  # noqa: E731
    return rf"""with recursive k as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) as tab),
c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(4294967295, list_reduce(list_prepend(4294967295,
    list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda s: cast(ascii(s) as bigint))),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % 20 as how from conversations, k),
d as (select conv_id, turn, case how when 4 then 'user' else role end as role, case how when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(case how when 0 then [] when 3 then [1, 2] else [1] end) as copy from c),
e as (select *, rtrim(text, e' 	
') as z, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as met,
    row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n from d),
f as materialized (select conv_id, turn, role, text, n, substr(role, 1, 1) as i, case when z = '' then 'blank' when met > 1 then 'duplicate' when right(z, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(substr(role, 1, 1)) over (partition by conv_id order by n) || substr(role, 1, 1) as pair from e),
w as (select conv_id, 0 as n, {{'c': 0, 't': '', 'x': ''}} as q, {{'c': 0, 't': '', 'x': ''}} as s, {{'c': 0, 't': '', 'x': ''}} as u, {{'c': 0, 't': '', 'x': ''}} as a from (select distinct conv_id from conversations)
  union all select conv_id, n, q1 as q, s1 as s, u1 as u, a1 as a from (select w.conv_id, f.n, {gone('q')} as q1, {best(gone('s0'), stay('q', 's'))} as s1,
    {best(gone('u0'), stay('q', 'u'), stay('s0', 'u'), stay('a0', 'u'), stay('u0', 'u', 'a'))} as u1,
    {best(gone('a0'), stay('q', 'a', 'u'), stay('s0', 'a', 'u'), stay('u0', 'a'), stay('a0', 'a', 'u'))} as a1
    from (select conv_id, n, q, case when n > 0 then s end as s0, case when n > 0 then u end as u0, case when n > 0 then a end as a0 from w) w
    join f on f.conv_id is not distinct from w.conv_id and f.n = w.n + 1)),
l as (select conv_id, arg_max({{'q': q, 's': case when n > 0 then s end, 'u': case when n > 0 then u end, 'a': case when n > 0 then a end}}, n) as w from w group by conv_id),
b as (select conv_id, {best('w.q', 'w.a', step('w.u', 3, "'I'", line("'assistant'", "''")), step('w.s', 6, "'II'", line("'user'", "''") + " || " + line("'assistant'", "''")))} as b from l),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
select b.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast(b.c as bigint) as cost, b.t as audit, sha256(substr(b.x, 2)) as repaired_sha256 from b left join g on g.conv_id is not distinct from b.conv_id"""


OP13 = _op13()

ORACLES = {"op3_html_text": OP3, "op7_near_dedup": OP7, "op8_suffix_dedup": OP8, "op11_phrases": OP11, "op12_exact_dedup": OP12, "op13_turn_repair": OP13}
