"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_NAME = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_LEAD = _NAME + "[\"'']?\\x20*[:=]\\x20*[\"'']?"
_PATTERNS = (
    (0, "assign", _LEAD + "[A-Za-z0-9+/_.=-]+", "^" + _LEAD, 8),
    (1, "access", "AKIA[A-Z0-9]{12,}", "^$", 0),
    (2, "hex", "[0-9a-f]{32,}", "^$", 0),
    (3, "bearer", "[bB]earer\\x20+[A-Za-z0-9._~+/-]{16,}", "^[bB]earer\\x20+", 0),
    (4, "prefixed", "(?:gh[pousr]_|xox[abps]-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}", "^$", 0),
    (5, "jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", "^$", 0),
)

_MATCHES = " union all ".join(
    f"""select row_id, {rank} as kind, '{kind}' as kind_name, unnest(regexp_extract_all(txt, '{pattern}')) as m,
        string_split_regex(txt, '{pattern}') as pieces, generate_subscripts(regexp_extract_all(txt, '{pattern}'), 1) as k,
        regexp_extract_all(txt, '{pattern}') as ms, '{lead}' as lead, {least} as least from docs"""
    for rank, kind, pattern, lead, least in _PATTERNS
)

SECRETS = f"""
with docs as (select row_number() over () as row_id, doc_id, coalesce(text, '') as txt, coalesce(source, '') as owner,
                     concat_ws('/', source, lang) as repository from documents),
found as ({_MATCHES}),
spans as (
    select row_id, kind, kind_name, regexp_replace(m, lead, '') as val, least,
           list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) as s,
           length(m) as n
    from found),
good as (select row_id, kind, kind_name, sha256(val) as h, s, s + n as e from spans where length(val) >= least),
owners as (
    select h, count(distinct owner) <= 3 and count(distinct (owner, repository)) <= 8 as live
    from good join docs using (row_id) group by h),
kept as (select g.*, o.live from good g join owners o using (h) where g.kind < 3 or o.live),
line as (
    select row_id,
           count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
           coalesce(string_agg(kind_name || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, kind) filter (kind < 3), '') as base,
           string_agg(kind_name || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, kind) as spans,
           count(*) filter (kind >= 3) as n_added, count(*) filter (live) as n_live
    from kept group by row_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_added, 0) as n_added, coalesce(n_live, 0) as n_live
from docs left join line using (row_id)
"""

CHATS = r"""
with given as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all
    select * from (values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))),
sized as (
    select *, length(regexp_extract_all(text, '<\\*\|(?:im_start|im_end)\|>')) as n_control,
           length(role) + length(regexp_extract_all(role, '[~|\n]')) as role_chars
    from given)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(role_chars + length(text) + n_control + 24) as bigint) as formatted_chars,
       cast(count(*) filter (n_control > 0) as bigint) as n_escaped
from sized group by conv_id
"""

_FIELDS = ("doc_id", "source", "lang", "{n}", "text")
_ENCODED = " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')" for c in _FIELDS)


def _up(nodes: str, key: str) -> str:
    """The nodes of all levels of the trees that stand on nodes(key, level 0, pos, h, total)."""
    return f"""
    select {key}, 0 as level, pos, h, total from {nodes}
    union all
    select {key}, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (max(total) + 1) // 2
    from {nodes}_up where total > 1 group by {key}, level, pos // 2"""


def _fold(name: str, nodes: str, key: str, start: str) -> str:
    """Siblings and digests of each row's way up the tree of its key."""
    return f"""
    {start}
    union all
    select f.rid, f.{key}, f.level + 1, f.pos // 2, (f.total + 1) // 2, proof || coalesce(n.h, ''),
           sha256(case when n.h is null then f.h when f.pos % 2 = 1 then n.h || f.h else f.h || n.h end)
    from {name} f left join {nodes}_up n on n.{key} is not distinct from f.{key} and n.level = f.level and n.pos = xor(f.pos, 1)
    where f.total > 1"""




def _crc(text: str) -> str:
    """CRC-32 of a text of letters below U+0800, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({text}, ''), lambda c:
        case when unicode(c) < 128 then [unicode(c)::bigint, 0, 0, 0, 0, 0, 0, 0]
        else [192::bigint + unicode(c) // 64, 0, 0, 0, 0, 0, 0, 0, 128 + unicode(c) % 64, 0, 0, 0, 0, 0, 0, 0] end))),
        lambda a, b: case when xor(a, b) % 2 = 1 then xor(xor(a, b) >> 1, 3988292384) else xor(a, b) >> 1 end))"""


MERKLE = f"""
with recursive docs as (
    select row_number() over () as rid, *, case when doc_id is not null and ({_crc("cast(doc_id as varchar)")}) % 7 = 0 then n_chars + 1 else n_chars end as more from documents),
hashed as (
    select rid, doc_id, lang, sha256({_ENCODED.format(n="n_chars")}) as h, sha256({_ENCODED.format(n="more")}) as told from docs),
leaves as (
    select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by lang) as total from hashed),
leaves_up as ({_up("leaves", "lang")}),
subroots as (
    select lang, h, 0 as one, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as total from leaves_up where total = 1),
subroots_up as ({_up("subroots", "one")}),
inner_way as ({_fold("inner_way", "leaves", "lang", "select rid, lang, 0 as level, pos, total, '' as proof, told as h from leaves")}),
outer_way as ({_fold("outer_way", "subroots", "one", "select w.rid, 0 as one, 0 as level, s.pos, s.total, w.proof, w.h from inner_way w join subroots s on s.lang is not distinct from w.lang where w.total = 1")})
select l.doc_id, l.h as leaf, s.h as subroot, r.h as root, sha256(w.proof) as proof_sha256, w.h as folded_root, w.h = r.h as verified
from leaves l join subroots s on s.lang is not distinct from l.lang join outer_way w on w.rid = l.rid and w.total = 1
join subroots_up r on r.total = 1
"""

SPELLING = f"""
with recursive runs as (
    select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents),
lowered as (
    select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as n from runs group by all),
hashed as (select *, {_crc("cast(doc_id as varchar) || ':' || w")} as h from lowered),
words as (
    select case when h % 199 = 0 then w[:h % length(w)] || w[h % length(w) + 2:] else w end as word, cast(sum(n) as bigint) as n
    from hashed group by 1 having sum(n) >= 5 and length(word) >= 6),
less as (
    select word, n, k, word[:k - 1] || word[k + 1:] as rest from (select word, n, unnest(range(1, length(word) + 1)) as k from words)),
near as (
    select a.word, b.word as other, b.n from less a join less b on a.rest = b.rest and a.k = b.k and a.word != b.word
    union select a.word, b.word, b.n from less a join words b on a.rest = b.word
    union select b.word, a.word, a.n from less a join words b on a.rest = b.word),
best as (
    select word, count(*) as n_near, max(n) as best_n, first(other order by n desc, other) as best from near group by word),
told as (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 5 * w.n then best end as form, case when best_n >= 5 * w.n then best_n end as form_n
    from words w left join best using (word)),
way as (
    select word, coalesce(form, word) as root, 0 as step from told
    union all
    select w.word, t.form, step + 1 from way w join told t on t.word = w.root where t.form is not null and t.form != w.root)
select t.word, t.form, (select arg_max(root, step) from way where way.word = t.word) as root, t.n, t.n_near, t.form_n from told t
"""

ORACLE_SQL = {"op4_secret_scan": SECRETS, "op11_chat_format": CHATS, "op12_merkle_manifest": MERKLE, "op13_spelling_variants": SPELLING}
