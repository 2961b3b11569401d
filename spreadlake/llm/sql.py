"""DuckDB texts of the operators that SQL can express."""

from spreadlake.llm.mixing import TURNS

_TURNED = "(draw + {t} / {n}.0 - floor(draw + {t} / {n}.0))"
_SUMS = ",\n    ".join(
    f"abs(cast(sum(case when {_TURNED.format(t=t, n=TURNS)} < rate - floor(rate) then size else 0 end) as double)"
    " - (max(target) - floor(max(rate)) * max(source_size)))"
    for t in range(TURNS)
)

MIXING = f"""
with sized as (
  select doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    cast(('0x' || substr(md5(doc_id::varchar || ':11'), 1, 8)) as bigint) / 4294967296.0 as draw
  from documents
),
per as (
  select source, sum(size)::bigint as source_size,
    case (row_number() over (order by encode(source) nulls last) - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight
  from sized group by source
),
filled as (
  select source, source_size, weight,
    1.5::double * (sum(source_size) over ())::double as wanted,
    coalesce(sum(source_size) over fill, 0)::double as full_before,
    (sum(weight) over ()) - coalesce(sum(weight) over fill, 0.0::double) as open_weight
  from per
  window fill as (order by source_size::double / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding)
),
levels as (
  select *, (wanted - 2.0::double * full_before) / open_weight as lvl, 2.0::double * source_size::double as own from filled
),
first_open as (
  select lvl from levels where lvl * weight <= own order by source_size::double / weight, encode(source) nulls last limit 1
),
opened as (
  select l.*, (select lvl from first_open) as level,
    (select min(source_size::double / weight) from levels where lvl * weight <= own) as opens
  from levels l
),
dim as (
  select source, source_size,
    case when level is null or source_size::double / weight < opens then own else least(level * weight, own) end as target
  from opened
),
rated as (
  select *, case when source_size > 0 then target / source_size else 0.0::double end as rate from dim
),
joined as (
  select s.doc_id, s.size, s.draw, r.* from sized s join rated r on s.source is not distinct from r.source
),
offs as (
  select source, [{_SUMS}] as off from joined group by source
),
turns as (
  select source, list_position(off, list_min(off)) - 1 as turn from offs
)
select j.doc_id, j.size, j.source_size, j.target,
  cast(j.size * (floor(j.rate) + case when j.draw + t.turn / {TURNS}.0 - floor(j.draw + t.turn / {TURNS}.0) < j.rate - floor(j.rate) then 1 else 0 end) as bigint) as taken
from joined j join turns t on j.source is not distinct from t.source
"""

_REACHED = """
reached as (
  select id, id as component from nodes
  union
  select l.b as id, r.component from reached r join links l on l.a = r.id where r.component < l.b
),
classes as (
  select id, min(component) as component from reached group by id
)
"""

NEAR_VECTORS = f"""
with recursive vectors as (
  select vec_id, label, embedding::double[] as v,
    coalesce(label is not null and vec_id is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as good
  from embeddings
),
links as (
  select x.vec_id as a, y.vec_id as b from vectors x join vectors y
    on x.good and y.good and x.label = y.label and len(x.v) = len(y.v) and x.vec_id <> y.vec_id
    and list_cosine_similarity(x.v, y.v) >= 0.93
),
nodes as (select vec_id as id from vectors),
{_REACHED}
select v.vec_id, (select count(*) from links l where l.a = v.vec_id) as n_links, c.component as component_id,
  v.vec_id = c.component as kept
from vectors v join classes c on c.id = v.vec_id
"""

JACCARD = f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
),
shingles as (
  select distinct doc_id, md5(array_to_string(w[i : i + 4], ' ')) as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)
),
sizes as (
  select d.doc_id, count(s.s) as n from documents d left join shingles s on s.doc_id = d.doc_id group by d.doc_id
),
shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as k from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2
),
links as (
  select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * k >= 75 * (p.n + q.n - k)
),
nodes as (select doc_id as id from documents),
{_REACHED}
select z.doc_id, z.n as n_shingles, c.component as component_id from sizes z join classes c on c.id = z.doc_id
"""

SUBSTRING = """
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
),
windows as (
  select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)
),
firsts as (select h, min(doc_id) as first_id from windows group by h having min(doc_id) < max(doc_id)),
cut as (
  select distinct doc_id, unnest(range(i, i + 50)) as i from windows join firsts using (h) where first_id < doc_id
),
each as (
  select doc_id, i, w[i] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words where len(w) > 0)
),
kept as (
  select e.doc_id, count(*) as n, string_agg(e.word, ' ' order by e.i) as t
  from each e anti join cut c on c.doc_id = e.doc_id and c.i = e.i group by e.doc_id
)
select w.doc_id, len(w.w) as n_words, len(w.w) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from words w left join kept k on k.doc_id = w.doc_id
"""

# what crc32 adds to the remainder for each value of four bits, written out as its published polynomial gives it
_NIBBLES = [0]
for _n in range(1, 16):
    for _ in range(4):
        _n = _n >> 1 ^ (0xEDB88320 if _n & 1 else 0)
    _NIBBLES.append(_n)


def crc32_sql(text: str) -> str:
    """crc32 of an ASCII text, four bits at a time."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c) & 15, ascii(c) >> 4]))"
    step = f"xor(r >> 4, {_NIBBLES}[(xor(r, n) & 15) + 1])"
    return f"xor(list_reduce({bits}, lambda r, n: {step}, 4294967295::bigint), 4294967295)"


def _spelled(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || {column}::varchar, '-')"


_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MANIFEST = f"""
with recursive leaves as (
  select doc_id, source, sha256({" || ".join(map(_spelled, _FIELDS))}) as leaf,
    sha256({" || ".join(map(_spelled, [*_FIELDS[:-1], _LOWER]))}) as changed,
    coalesce({crc32_sql("doc_id::varchar")} % 5 = 0, false) as tampered
  from documents
),
placed as (
  select *, row_number() over (order by source nulls first, doc_id nulls first, leaf) as rid,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos
  from leaves
),
trees as (
  select source, 0 as lvl, list(leaf order by pos) as nodes from placed group by source
  union all
  select source, lvl + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1 : i + 16], '')))
  from trees where len(nodes) > 1
),
subroots as (
  select source, nodes[1] as subroot, row_number() over (order by encode(source) nulls first) - 1 as pos from trees where len(nodes) = 1
),
tops as (
  select 0 as lvl, list(subroot order by pos) as nodes from subroots
  union all
  select lvl + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1 : i + 16], ''))) from tops where len(nodes) > 1
),
sided as (
  select p.rid, t.lvl as step, t.nodes, (p.pos // (16 ** t.lvl)::bigint) as ix
  from placed p join trees t on t.source is not distinct from p.source and len(t.nodes) > 1
  union all
  select p.rid, 1000 + t.lvl as step, t.nodes, (s.pos // (16 ** t.lvl)::bigint) as ix
  from placed p join subroots s on s.source is not distinct from p.source join tops t on len(t.nodes) > 1
),
steps as (
  select rid, row_number() over (partition by rid order by step) as step,
    array_to_string(nodes[ix // 16 * 16 + 1 : ix], '') as before, array_to_string(nodes[ix + 2 : ix // 16 * 16 + 16], '') as after
  from sided
),
proofs as (select rid, string_agg(before || after, '' order by step) as proof from steps group by rid),
folding as (
  select rid, 0::bigint as step, case when tampered then changed else leaf end as node from placed
  union all
  select f.rid, s.step, sha256(s.before || f.node || s.after) from folding f join steps s on s.rid = f.rid and s.step = f.step + 1
),
folds as (select rid, arg_max(node, step) as folded_root from folding group by rid)
select p.doc_id, p.leaf, s.subroot, (select nodes[1] from tops where len(nodes) = 1) as root,
  sha256(coalesce(r.proof, '')) as proof_sha256, f.folded_root, f.folded_root = (select nodes[1] from tops where len(nodes) = 1) as verified
from placed p join subroots s on s.source is not distinct from p.source join folds f on f.rid = p.rid left join proofs r on r.rid = p.rid
"""

# the least (cost, edits) in front of a row for the four states of what the repaired roles end in
# (n nothing, s system, u user, a assistant), from those behind it
_AFTER = {"n": "u", "s": "u", "u": "a", "a": "u"}


def _least(options: list[str]) -> str:
    return f"list_min([{', '.join(options)}])"


def _edit(cost: str, letter: str, state: str) -> str:
    return f"struct_pack(c := {cost} + b.{state}.c, e := '{letter}' || b.{state}.e)"


def _row(state: str) -> str:
    never = "struct_pack(c := 1000000000, e := '')"
    more = "case when r.fault = 'truncated' then 3 else 0 end"
    due = _AFTER[state]
    keeps = {due: due[0]} | ({"s": "s"} if state == "n" else {})
    options = [_edit("4", "D", state), f"case when r.fault in ('fine', 'truncated') then {_edit(f'3 + {more}', 'R', due)} else {never} end"]
    for to, initial in keeps.items():
        options.append(f"case when r.fault in ('fine', 'truncated') and r.initial = '{initial}' then {_edit(more, 'K', to)} else {never} end")
    return _least(options)


def _inserts(state: str) -> str:
    options, cost, edits, s = [f"w.{state}"], 0, "", state
    for _ in range(3):
        s, cost, edits = _AFTER[s], cost + 3, edits + "I"
        options.append(f"struct_pack(c := {cost} + w.{s}.c, e := '{edits}' || w.{s}.e)")
    return _least(options) + f" as {state}"


_LAST = "struct_pack(c := 0, e := '') as n, struct_pack(c := 6, e := 'II') as s, struct_pack(c := 3, e := 'I') as u, struct_pack(c := 0, e := '') as a"

REPAIR = f"""
with recursive fresh as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as damage
  from conversations
),
hurt as (
  select conv_id, turn, case when damage = 4 then 'user' else role end as role,
    case damage when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as place
  from fresh, unnest(case when damage = 3 then [0, 1] else [0] end) where damage <> 0
),
judged as (
  select conv_id, turn, role, text, place, substr(role, 1, 1) as initial,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
      when place > min(place) over (partition by conv_id, role, text) then 'duplicate'
      when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 'truncated' else 'fine' end as fault
  from hurt
),
paired as (
  select *, lag(initial) over (partition by conv_id order by place) as earlier, count(*) over (partition by conv_id) as total from judged
),
best as (
  select conv_id, max(place) + 1 as place, {_LAST} from judged group by conv_id
  union all
  select conv_id, place, {", ".join(map(_inserts, "nsua"))} from (
    select r.conv_id, r.place, {", ".join(f"{_row(s)} as {s}" for s in "nsua")}
    from best b join judged r on r.conv_id is not distinct from b.conv_id and r.place = b.place - 1
  ) w
),
chosen as (select conv_id, n.c as cost, n.e as audit from best where place = 1),
letters as (
  select conv_id, audit, i, substr(audit, i, 1) as letter,
    len(replace(substr(audit, 1, i), 'I', '')) as place
  from chosen, unnest(range(1, len(audit) + 1)) as t(i)
),
lines as (
  select l.conv_id, l.i, l.letter, r.role, r.text,
    sum(case when l.letter = 'D' or (l.letter = 'K' and r.initial = 's') then 0 else 1 end) over (partition by l.conv_id order by l.i) as due
  from letters l left join judged r on r.conv_id is not distinct from l.conv_id and r.place = l.place and l.letter <> 'I'
),
texts as (
  select conv_id, string_agg(
    case when letter = 'K' then role when due % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end,
    chr(10) order by i) as t
  from lines where letter <> 'D' group by conv_id
),
stats as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (place > 1 and earlier || initial not in ('su', 'ua', 'au')) as illegal
  from paired group by conv_id
),
ids as (select distinct conv_id from conversations)
select d.conv_id, {", ".join(f"coalesce(s.{c}, 0)::bigint as {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
  coalesce(c.cost, 0)::bigint as cost, coalesce(c.audit, '') as audit, sha256(coalesce(x.t, '')) as repaired_sha256
from ids d left join stats s on s.conv_id is not distinct from d.conv_id left join chosen c on c.conv_id is not distinct from d.conv_id
  left join texts x on x.conv_id is not distinct from d.conv_id
"""
