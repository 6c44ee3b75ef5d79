"""SQL for the queries that SQL can express over whole tables: containment, quotation links, vector codes, negatives, licenses."""

from lodestone.llm import chat, contamination, licenses, negatives, vector_codes
from lodestone.llm.license_rules import RULES

CONTAMINATION = rf"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') as w from documents),
  i as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') as w from benchmark),
  widths as (select distinct least({contamination.WIDTH}, len(w)) as k from i where len(w) > 0),
  ds as (select distinct doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) as s from d, widths),
  items as (select distinct item_id, least({contamination.WIDTH}, len(w)) as k,
    unnest(list_transform(range(1, len(w) - least({contamination.WIDTH}, len(w)) + 2), lambda p: array_to_string(w[p:p + least({contamination.WIDTH}, len(w)) - 1], ' '))) as s
    from i where len(w) > 0),
  sized as (select *, count(*) over (partition by item_id) as n from items)
select doc_id, item_id, any_value(n) as n_shingles, count(*) as n_shared, count(*) / any_value(n) as containment
from ds join sized using (k, s) group by doc_id, item_id having count(*) >= {contamination.THRESHOLD} * any_value(n) - 1e-9
"""

_NORMAL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"

CHAT = rf"""
with recursive split as (
    select conv_id, turn, role, coalesce(text, '') as text, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') as l from conversations),
  lines as (select conv_id, turn, unnest(l) as line, generate_subscripts(l, 1) as n from split),
  leveled as (
    select *, length(regexp_replace(regexp_extract(line, '^([ \t]*>)+'), '[^>]', '', 'g')) as level, regexp_replace(line, '^([ \t]*>)+ ?', '') as body from lines),
  turned as (select *, lag(level) over w is distinct from level as turns, lead(level) over w as below from leveled window w as (partition by conv_id, turn order by n)),
  runs as (
    select *, sum(turns::int) over (partition by conv_id, turn order by n) as run from turned
    qualify not (level = 0 and below > 0 and regexp_matches(lower(body), '{chat.ATTRIBUTION}'))),
  counted as (select conv_id, turn, count(*) filter (turns and level > 0) as n_quotes from turned group by all),
  own as (select conv_id, turn, string_agg(body, chr(10) order by n) as words from runs where level = 0 group by all),
  said as (
    select s.conv_id, s.turn, s.role, c.n_quotes,
      case when c.n_quotes = 0 then s.text else regexp_replace(coalesce(o.words, ''), '^\s+|\s+$', '', 'g') end as text
    from split s join counted c using (conv_id, turn) left join own o using (conv_id, turn)),
  wholes as (select conv_id, turn, level, {_NORMAL.format("string_agg(body, ' ' order by n)")} as unit from runs group by conv_id, turn, level, run),
  units as (
    select distinct * from (select * from wholes union all select conv_id, turn, level, {_NORMAL.format("body")} from runs
      union all select conv_id, turn, 0, {_NORMAL.format("text")} from said) where unit <> ''),
  found as (
    select q.conv_id, q.turn, q.level, q.unit, max(o.turn) as source from units q join units o
      on q.conv_id = o.conv_id and q.unit = o.unit and q.level > 0 and o.level = 0 and o.turn < q.turn group by all),
  weights as (select conv_id, turn, level, source, sum(length(unit)) as chars, count(*) as n from found group by all),
  replies as (
    select conv_id, turn, source as reply_to, sum(n) over (partition by conv_id, turn) as n_linked from weights
    qualify row_number() over (partition by conv_id, turn order by level, chars desc, source desc) = 1),
  threads as (
    select conv_id, turn, reply_to as root from replies
    union all select t.conv_id, t.turn, r.reply_to from threads t join replies r on r.conv_id = t.conv_id and r.turn = t.root)
select s.conv_id, s.turn, s.role, s.text, s.n_quotes, cast(coalesce(r.n_linked, 0) as bigint) as n_linked, r.reply_to,
  coalesce((select min(root) from threads t where t.conv_id = s.conv_id and t.turn = s.turn), s.turn) as thread,
  concat('<|', coalesce(s.role, ''), '|>', chr(10), s.text) as formatted
from said s left join replies r using (conv_id, turn)
"""


def _vector_codes() -> str:
    """Rounds are chained table expressions: assignment to book k, then book k + 1."""
    parts, entries, rounds = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
  far{k} as materialized (
    select x.id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) as distance
    from x join book{k} b using (part, position) group by x.id, x.part, b.entry),
  near{k} as materialized (
    select id, part, cast(arg_min(entry, (distance, entry)) as bigint) as entry, cast(min(distance) as bigint) as distance from far{k} group by id, part)""")
        if k < rounds:
            steps.append(f"""
  book{k + 1} as materialized (
    select b.part, b.entry, b.position, coalesce(m.v, b.v) as v from book{k} b left join (
      select n.part, n.entry, x.position, cast(floor(sum(x.v)::double / count(*)) as bigint) as v
      from near{k} n join x using (id, part) group by n.part, n.entry, x.position) m using (part, entry, position))""")
    return f"""
with used as (
    select row_number() over (order by vec_id nulls last, embedding) - 1 as id, vec_id, label, embedding from embeddings
    where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
  numbers as (
    select id, unnest(embedding) as e, generate_subscripts(embedding, 1) - 1 as d, len(embedding) // {parts} as size from used),
  x as materialized (
    select id, d // size as part, d % size as position, cast(floor({vector_codes.SCALE} * e::double) as bigint) as v from numbers),
  book0 as materialized (select part, id as entry, position, v from x where id < {entries}),{",".join(steps)},
  codes as (
    select id, string_agg(printf('%02x', entry), '' order by part) as code, sum(distance) as error from near{rounds} group by id),
  said as (select sha256(string_agg(cast(v as varchar), ',' order by part, entry, position)) as digest from book{rounds})
select u.vec_id, c.code, cast(c.error as bigint) as error, cast(sum(c.error) over (partition by u.label) as bigint) as label_error, s.digest as codebooks_sha256
from codes c join used u using (id) cross join said s
"""


VECTOR_CODES = _vector_codes()


def _licenses() -> str:
    """All patterns over all texts that hold their keywords; containment by a self-join of a document's detections."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ",\n    ".join(
        f"({r.number}, {quoted(r.label)}, {r.rank}, {r.confidence}, {r.base}, {quoted(licenses.pattern_of(r))}, [{', '.join(quoted(licenses.spaced(k)) for k in r.keyword.split('|'))}])" for r in RULES
    )
    return rf"""
with rules(rule, label, rank, confidence, base, pattern, phrases) as (values
    {rules}),
  folded as (
    select doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.BETWEEN}', '  ', 'g')) as f
    from documents),
  docs as materialized (
    select row_number() over () as row, doc_id, case when f = '' then '' else ' ' || f || ' ' end as padded,
      case when f = '' then 0 else len(string_split(f, '  ')) end as n_words from folded),
  phrases as (select unnest(phrases) as phrase, rule from rules),
  tried as (select distinct d.row, p.rule from docs d join phrases p on contains(d.padded, p.phrase)),
  marked as (
    select row, rule, label, rank, confidence, base, string_split(trim(regexp_replace(padded, pattern, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g')), '  ') as w
    from tried join rules using (rule) join docs using (row)),
  words as (
    select row, rule, label, rank, confidence, base, unnest(w) as word, generate_subscripts(w, 1) as n from marked where len(list_filter(w, lambda x: contains(x, chr(1)))) > 0),
  edges as (
    select row, rule, label, rank, confidence, base, n, word, lead(n) over (partition by row, rule order by n) as ahead
    from words where starts_with(word, chr(1)) or ends_with(word, chr(2))),
  found as materialized (
    select row, rule, label, rank, confidence, base, n - 1 as start, case when ends_with(word, chr(2)) then n else ahead end as stop
    from edges where starts_with(word, chr(1))),
  stays as materialized (
    select * from found d where not exists (
      select 1 from found e where e.row = d.row and e.start <= d.start and e.stop >= d.stop and e.rank <= d.rank and e.rule <> d.rule
        and (e.start < d.start or e.stop > d.stop or e.rank < d.rank or e.rule < d.rule))),
  based as (
    select row, count(*) as n_base, min(start) as first_word, max(start) as last_word, string_agg(distinct label, ',' order by label) as base_labels
    from found where base group by row),
  said as (
    select row, string_agg(distinct label, ',' order by label) as labels from (
      select row, label from stays union all select row, label from found where base) group by row),
  counts as (select row, count(*) as n from found group by row),
  scores as (select row, max(confidence) as score, count(*) as n from stays group by row)
select d.doc_id, cast(d.n_words as bigint) as n_words, coalesce(b.n_base, 0) as n_base, b.first_word, b.last_word, coalesce(b.base_labels, '') as base_labels,
  coalesce(s.labels, '') as labels, cast(coalesce(p.score, 0) as double) as score, coalesce(c.n, 0) - coalesce(p.n, 0) as n_suppressed
from docs d left join based b using (row) left join said s using (row) left join counts c using (row) left join scores p using (row)
"""


LICENSES = _licenses()

HARD_NEGATIVES = f"""
with used as materialized (
    select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
      list_transform(embedding, lambda e: floor({negatives.SCALE} * e::double)) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
  scores as materialized (
    select a.row as anchor, a.vec_id as anchor_id, b.row, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
    from used a join used b on a.vec_id % {negatives.EVERY} = 0 and a.row <> b.row),
  positives as (
    select *, row_number() over (partition by anchor order by score desc, vec_id) as number from scores where same
    qualify row_number() over (partition by anchor order by score desc, vec_id) <= {negatives.POSITIVES})
select p.anchor_id, p.vec_id as positive_id,
  cast(row_number() over (partition by p.anchor, p.number order by n.score desc, n.vec_id) as integer) as rank,
  n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scores n on n.anchor = p.anchor and not n.same
  and {negatives.LOW} * p.score <= 100 * n.score and 100 * n.score <= {negatives.HIGH} * p.score
qualify row_number() over (partition by p.anchor, p.number order by n.score desc, n.vec_id) <= {negatives.NEGATIVES}
"""
