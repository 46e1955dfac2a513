"""DuckDB twins of the queries that SQL can express.

They state the results in their own way: windows by list slices, templates as
regular expressions over blank-padded words, links by all pairs of like length.
"""

from __future__ import annotations

from packetloom.llm.license_texts import PHRASES, TEMPLATES
from packetloom.llm.licenses import Node, parse_template
from packetloom.llm.line_dedup import EDITS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


# --- licences: every word stands as ' word ' --------------------------------


def _pattern(nodes: list[Node]) -> str:
    out = []
    for node in nodes:
        if node[0] == "word":
            out.append(" " + node[1].replace(".", "[.]") + " ")
        elif node[0] == "any":
            out.append(f"(?: [^ ]+ ){{{node[1]},{node[2]}}}")
        else:
            out.append(f"(?:{_pattern(node[1])})?")
    return "".join(out)


def _mandatory(nodes: list[Node]) -> int:
    return sum(n[0] == "word" for n in nodes)


def op1_sql() -> str:
    found, scores = [], []
    for label, text in TEMPLATES:
        nodes = parse_template(text)
        test = f"regexp_matches(s, '{_pattern(nodes)}')"
        m = _mandatory(nodes)
        found.append(f"case when {test} then '{label}' end")
        scores.append(f"case when {test} then {m}::double / {m + 2} else 0::double end")
    starts = []
    for phrase, label in PHRASES:
        parts = phrase.split(" ")
        same = " and ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        starts.append(f"list_filter(range(1, greatest(len(w) - {len(parts) - 2}, 1)), lambda i: {same})")
    labels = [
        f"case when len(p{i}) > 0 then '{label}' end" for i, (_, label) in enumerate(PHRASES)
    ]

    def joined(items: list[str]) -> str:
        return (
            f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(items)}], "
            "lambda x: x is not null))), ',')"
        )

    every = " || ".join(f"p{i}" for i in range(len(PHRASES)))
    return (
        f"with a as (select doc_id, {_WORDS} as w from documents), "
        "b as (select *, concat(' ', array_to_string(w, '  '), ' ') as s, "
        + ", ".join(f"{s} as p{i}" for i, s in enumerate(starts))
        + f" from a), c as (select *, {every} as places, {joined(labels)} as base_labels, "
        f"{joined(labels + found)} as labels from b) "
        "select doc_id, cast(len(w) as bigint) as n_words, cast(len(places) as bigint) as n_base, "
        "list_min(places) - 1 as first_word, list_max(places) - 1 as last_word, base_labels, labels, "
        f"greatest({', '.join(scores)}, case when len(places) > 0 then 0.5::double else 0::double end) as score from c"
    )


# --- benchmark windows ------------------------------------------------------

OP4_SQL = f"""with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
i as (select distinct item_id, n, array_to_string(w[k : k + n - 1], ' ') as window from (
  select item_id, w, n, unnest(range(1, len(w) - n + 2)) as k from (
    select item_id, w, least(10, len(w)) as n from b where len(w) > 0))),
s as (select r, n, k, array_to_string(w[k : k + n - 1], ' ') as window from (
  select r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) as k from d, (select distinct n from i))),
h as (select s.r, s.n, s.k, i.item_id from s join i on s.n = i.n and s.window = i.window),
x as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from h) group by r),
y as (select r, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
  from (select distinct r, item_id from h) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join x on d.r = x.r left join y on d.r = y.r"""


# --- lines ------------------------------------------------------------------

_TRIM = r"trim({0}, e' \t\x0b\x0c\r')"
# DuckDB's distance counts bytes, at most four to a character: it only narrows the pairs;
# edits are then tried one by one where the characters of two lines first differ
OP9_SQL = f"""with recursive d as (select doc_id, string_split(coalesce(text, ''), e'\\n') as parts from documents),
e as (select doc_id, n - 1 as line_no, {_TRIM.format("parts[n]")} as line from (
  select doc_id, parts, unnest(range(1, len(parts) + 1)) as n from d)),
l as (select * from e where line <> ''),
u as (select line, length(line) as size, min((doc_id, line_no)) as first from l group by line),
q as (select a.line as a, b.line as b from u a join u b on b.size between a.size and a.size + {EDITS}
  and a.line <> b.line and levenshtein(a.line, b.line) <= {4 * EDITS}),
t as (
  select a, b, string_split(a, '') as x, string_split(b, '') as y, {EDITS} as k from q
  union
  select a, b, x[split + (way <> 'b')::int:], y[split + (way <> 'a')::int:], k - 1 from (
    select *, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i]), true),
      least(len(x), len(y)) + 1) as split, unnest(['a', 'b', 'both']) as way
    from t where k > 0 and x <> y)),
p as (select distinct a, b from t where x = y),
links as (select a, b from p union select b, a from p),
degree as (select a as line, count(*) as n_links from links group by 1),
reach as (select a as line, a as other from links union select r.line, k.b from reach r join links k on r.other = k.a),
least as (select r.line, min(u.first) as first from reach r join u on r.other = u.line group by 1),
c as (select u.line, coalesce(least.first, u.first) as first, coalesce(n_links, 0) as n_links
  from u left join least on u.line = least.line left join degree on u.line = degree.line),
o as (select l.doc_id, l.line_no, c.n_links, (l.doc_id, l.line_no) <> c.first as again from l join c on l.line = c.line)
select d.doc_id, count(*) filter (again) as n_removed, cast(coalesce(sum(n_links), 0) as bigint) as n_links,
  coalesce(list_sort(list(cast(line_no as int)) filter (again)), []::int[]) as removed
from d left join o on d.doc_id = o.doc_id group by d.doc_id"""


# --- chats ------------------------------------------------------------------

OP10_SQL = f"""with m as (select conv_id, turn, role, text, len({_SPACED}) as words from conversations),
u as (select conv_id, turn from m where role = 'user'), a as (select conv_id, turn - 1 as turn from m where role = 'assistant'),
e as (
  select m.*, case when role = 'assistant' then 'result' else 'message' end as kind,
    case when role = 'assistant' then concat('call-', turn - 1) end as call_id,
    case when role = 'assistant' then exists (select * from u where u.conv_id = m.conv_id and u.turn = m.turn - 1) end as linked
  from m
  union all
  select m.*, 'call', concat('call-', turn), exists (select * from a where a.conv_id = m.conv_id and a.turn = m.turn)
  from m where role = 'user')
select conv_id, turn, kind, row_number() over (partition by conv_id order by turn, kind = 'call') as position, call_id, linked,
  case when kind = 'call' then words between 1 and 60 and length(text) > 0 end as valid,
  case when kind = 'call' then list_filter([
    case when length(text) = 0 then '$.prompt: below minLength' end,
    case when words < 1 then '$.words: below minimum' end,
    case when words > 60 then '$.words: above maximum' end], lambda x: x is not null) end as errors,
  case kind
    when 'call' then concat('{{"call":{{"arguments":{{"prompt":', cast(to_json(text) as varchar), ',"words":', words,
      '}},"id":"', call_id, '","name":"reply"}},"role":"', role, '"}}')
    when 'result' then concat('{{"content":', cast(to_json(text) as varchar), ',"result_of":"', call_id, '","role":"', role, '"}}')
    else concat('{{"content":', cast(to_json(text) as varchar), ',"role":"', role, '"}}') end as json
from e"""


# --- collocations: every phrase by list slices ---------------------------------

OP13_SQL = rf"""with p as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
    '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
f as (
  select lang, g, len(g) as k, count(*) as f from (
    select lang, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: w[i:i + k - 1])) as g
    from w, (select unnest([1, 2, 3]) as k))
  group by all),
n as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang),
c as (select * from f where k > 1 and f >= 10),
inner_of as (select lang, g, max(f) as host from (
  select lang, unnest([g[1:2], g[2:3]]) as g, f from c where k = 3) group by all),
kept as (select c.* from c left join inner_of i using (lang, g) where host is null or 100 * host < 50 * f),
cuts as (
  select kept.lang, kept.g, kept.f as a, cut, x.f as l, y.f as r,
    cast(1000000::hugeint * kept.f * kept.f // (x.f::hugeint * y.f) as bigint) as score
  from kept, (select unnest([1, 2]) as cut), f x, f y
  where cut < kept.k and x.lang = kept.lang and y.lang = kept.lang and x.g = kept.g[1:cut] and y.g = kept.g[cut + 1:kept.k]),
best as (select * from cuts qualify row_number() over (partition by lang, g order by score, cut) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(array_to_string(g, ' '))) as rank from best)
select lang, rank, array_to_string(g, ' ') as phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000"""


# --- conversation repair: the cheapest way to every state, row by row ------------

_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(k, ''), lambda c: ord(c)::ubigint)), "
    "lambda acc, b: list_reduce(list_prepend(xor(acc, b), list_transform(range(8), lambda i: 0::ubigint)), "
    "lambda x, y: case when x % 2 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint)"
)
#: states: 0 nothing, 1 system, 2 user, 3 assistant; what inserts lead to
_INSERTS = "(values (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 2, 0, ''), (2, 3, 2, 'I'), (3, 3, 0, ''), (3, 2, 2, 'I'))"
_STEPS = "(values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2))"

OP11_SQL = f"""with recursive o as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) as k from conversations),
c as (select *, {_CRC32} % 20 as code from o),
d as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
    case when code = 1 then '' when code = 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when code = 3 then 2 else 1 end)) as copy
  from c where code <> 0),
p as (
  select *, row_number() over w as pos, lag(left(role, 1)) over w || left(role, 1) as pair,
    rtrim(text, e' \\t\\n\\x0b\\f\\r') as shown,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again
  from d window w as (partition by conv_id order by turn nulls first, role, text, copy)),
f as (select *, shown = '' as blank, shown <> '' and again as duplicate,
  shown <> '' and not again and right(shown, 1) not in ('.', '!', '?') as truncated from p),
g as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as rows
  from f group by conv_id),
e as (
  select conv_id, pos, q, q as q2, 3 as c, 'D' as s from f, (select unnest([0, 1, 2, 3]) as q)
  union all
  select conv_id, pos, q, q2, truncated::int, 'K' from f, {_STEPS} t(q, r, q2) where not blank and not duplicate and left(role, 1) = r
  union all
  select conv_id, pos, q, q2, 2 + truncated::int, 'R' from f, {_STEPS} t(q, r, q2) where not blank and not duplicate and r <> 's'),
r as (
  select conv_id, 0::bigint as pos, q2 as q, c, s as a from g, {_INSERTS} t(q, q2, c, s) where q = 0
  union all
  select conv_id, pos, q, c, a from (
    select r.conv_id, e.pos, i.q2 as q, r.c + e.c + i.c as c, r.a || e.s || i.s as a
    from r join e on e.conv_id is not distinct from r.conv_id and e.pos = r.pos + 1 and e.q = r.q
    join {_INSERTS} i(q, q2, c, s) on i.q = e.q2)
  qualify row_number() over (partition by conv_id, q order by c, a) = 1),
best as (
  select g.conv_id, r.c, r.a from g join r on r.conv_id is not distinct from g.conv_id and r.pos = g.rows
  where r.q in (0, 3) qualify row_number() over (partition by g.conv_id order by r.c, r.a) = 1),
steps as (select conv_id, unnest(string_split(a, '')) as s, generate_subscripts(string_split(a, ''), 1) as nr from best where a <> ''),
told as (
  select conv_id, s, nr, sum((s <> 'I')::int) over w as pos, sum((s <> 'D')::int) over w as place,
    sum((s <> 'D')::int) over (partition by conv_id) as total
  from steps window w as (partition by conv_id order by nr)),
texts as (
  select t.conv_id, sha256(string_agg(
    case when s = 'K' then f.role when (place - total % 2) % 2 = 1 then 'user' else 'assistant' end || ':' ||
    case when s = 'I' then '' else f.text end, e'\\n' order by nr)) as sha
  from told t join f on f.conv_id is not distinct from t.conv_id and f.pos = greatest(t.pos, 1) where s <> 'D' group by t.conv_id)
select ids.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(c, 0)::bigint as cost,
  coalesce(a, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) ids
left join g on g.conv_id is not distinct from ids.conv_id
left join best on best.conv_id is not distinct from ids.conv_id
left join texts on texts.conv_id is not distinct from ids.conv_id"""


# --- near vectors: all pairs of a label ----------------------------------------

OP12_SQL = """with recursive v as (
  select vec_id, label, embedding::double[] as x from embeddings
  where label is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
    and len(list_filter(embedding, lambda e: e <> 0)) > 0),
e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.x, b.x) >= 0.93),
r as (select vec_id, vec_id as other from embeddings union select r.vec_id, e.b from r join e on r.other = e.a),
c as (select vec_id, min(other) as component_id from r group by vec_id),
n as (select a as vec_id, count(*) as n_links from e group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from c left join n using (vec_id)"""


SQL = {
    "op1_license_scan": op1_sql(),
    "op4_decontaminate": OP4_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_tool_calls": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_embedding_dedup": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
