"""DuckDB SQL of the numbered operators' queries, where SQL can express them."""

_URL = r"^([a-z][a-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?"

OP1 = rf"""
with parts as (
  select page_id, url, date '2020-01-01' + cast(page_id * 37 % 1461 as int) as fetched_on, page_id * 13 % 1461 as d0,
         regexp_replace(regexp_extract(lower(trim(url)), '{_URL}', 2), '\.+$', '') as host, regexp_extract(lower(trim(url)), '{_URL}', 3) as path,
         regexp_extract(lower(trim(url)), '{_URL}', 4) as query
  from pages),
rules as (
  select page_id, d0, 'block' as list, 'host' as kind, host as pattern, 'spam' as category from parts where page_id % 5 = 0 and host <> ''
  union all select page_id, d0, 'block', 'url', host || path || query, 'malware' from parts where page_id % 7 = 0 and host <> ''
  union all select page_id, d0, 'allow', 'path', host || '/' || string_split(path, '/')[2], 'editorial' from parts where page_id % 11 = 0 and host <> ''
  union all select page_id, d0, 'block', 'domain', array_to_string(string_split(host, '.')[-2:], '.'), 'ads' from parts where page_id % 13 = 0 and host <> ''),
events as (
  select list, kind, pattern, category, date '2020-01-01' + cast(d0 as int) as day, 'add' as action from rules where pattern is not null
  union select list, kind, pattern, category, date '2020-01-01' + cast(d0 + 60 + page_id % 200 as int), 'remove' from rules where page_id % 2 = 0 and pattern is not null),
daily as (
  select list, kind, pattern, day, max(action) as action, min(case when action = 'add' then category end) as category from events group by all),
spans as (
  select list, kind, pattern, category, day as valid_from, action, lead(day) over (partition by list, kind, pattern order by day) as valid_to from daily),
folders as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as f, string_split(host, '.') as l from parts where host <> ''),
keys as (
  select distinct page_id, url, fetched_on, kind, key from (
    select page_id, url, fetched_on, 'url' as kind, host || path || query as key from folders
    union all select page_id, url, fetched_on, 'host', host from folders
    union all select page_id, url, fetched_on, 'domain', array_to_string(l[i:], '.') from folders, unnest(range(1, greatest(len(l) - 1, 1) + 1)) as t(i)
    union all select page_id, url, fetched_on, 'path', host || '/' || array_to_string(f[:i], '/') from folders, unnest(range(1, greatest(len(f), 1) + 1)) as t(i))),
hits as (
  select k.page_id, k.url, k.fetched_on, s.*,
         row_number() over (partition by k.page_id, k.url order by case s.kind when 'url' then 0 when 'path' then 1 when 'host' then 2 else 3 end,
                            -length(s.pattern), case when s.list = 'allow' then 0 else 1 end, s.list, s.pattern) as r,
         count(*) over (partition by k.page_id, k.url) as n
  from keys k join spans s on s.kind = k.kind and s.pattern = k.key and s.action = 'add' and s.valid_from <= k.fetched_on
       and (s.valid_to is null or k.fetched_on < s.valid_to))
select p.page_id, p.url, p.fetched_on, case when h.list is null then 'unlisted' when h.list = 'allow' then 'allowed' else 'blocked' end as decision,
       h.kind as matched_kind, h.pattern as matched_pattern, h.category, h.valid_from, coalesce(h.n, 0) as n_active
from parts p left join hits h on h.page_id = p.page_id and h.url = p.url and h.r = 1
"""

OP2 = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
c as (select *, list_transform(range(0, 8), lambda i: cast('0x' || substr(h, cast(1 + 5 * i as int), 5) as int)) as five,
             max(page_id) over (partition by html) as response from p)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
       array_to_string(flatten(list_transform(five, lambda v: list_transform([32768, 1024, 32, 1], lambda d:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(v // d % 32 + 1 as int), 1)))), '') as payload_digest,
       case when page_id = response then 'response' else 'revisit' end as record_type,
       case when page_id <> response then response end as refers_to
from c
"""

OP5 = """
with sums as (select source, sum(length(coalesce(text, ''))) as chars from documents group by source),
targets as (select source, cast(chars as double) as chars, case when chars > 0 then pow(cast(chars as double), 0.7) else 0 end as target from sums),
rates as (select source, case when chars > 0 then target * (select sum(chars) from targets) / ((select sum(target) from targets) * chars) else 0 end as rate from targets),
terms as (select source, rate, k, case when rate > 0 then exp(-rate + k * ln(rate) - lgamma(k + 1)) else 1 end as p
          from rates, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 20) as int) + 1)) as t(k) where rate > 0 or k = 0),
steps as (select source, rate, list(c order by k) as steps from
            (select source, rate, k, sum(p) over (partition by source order by k) as c from terms) group by source, rate),
drawn as (
  select d.*, s.rate, md5(coalesce(d.text, '')) as h, len(list_filter(s.steps, lambda p: p <=
           cast('0x' || substr(md5('mix-1|' || coalesce(cast(d.doc_id as varchar), '') || '|' || md5(coalesce(d.text, ''))), 1, 13) as bigint) / pow(2.0, 52))) as copies
  from documents d join steps s on s.source is not distinct from d.source)
select doc_id, text, lang, source, n_chars, round(rate, 6) as rate, cast(copies as int) as copies, cast(copy as int) as copy,
       cast('0x' || substr(md5('mix-1-order|' || coalesce(cast(doc_id as varchar), '') || '|' || h || '|' || copy), 1, 13) as bigint) / pow(2.0, 52) as mix_key
from drawn, unnest(range(1, copies + 1)) as t(copy)
"""

OP6 = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from g group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b from g a join g b on a.s = b.s and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, r.component_id
from documents d left join n on n.doc_id = d.doc_id join (select a, min(b) as component_id from reach group by a) r on r.a = d.doc_id
"""

OP9 = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings
  where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
          where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on l.a = r.b),
c as (select a, min(b) as component_id from reach group by a)
select e.vec_id, (select count(*) from links where links.a = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on c.a = e.vec_id
"""

OP10 = r"""
with c as (select conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations),
r as (select conv_id, turn, coalesce(role, 'user') as role,
             coalesce(case when role = 'assistant' and turn >= conv_id % 3 + 1 then 'Well: ' || text else text end, '') as text
      from conversations where conv_id % 4 <> 0 or turn <= conv_id % 3 + 2),
cn as (select *, row_number() over (partition by conv_id order by turn, role, text) as i from c),
rn as (select *, row_number() over (partition by conv_id order by turn, role, text) as i from r),
ids as (select conv_id, coalesce(max(nc), 0) as nc, coalesce(max(nr), 0) as nr from (
          select conv_id, count(*) as nc, null as nr from c group by conv_id union all select conv_id, null, count(*) from r group by conv_id) group by conv_id),
same as (select ids.*, coalesce((select min(a.i) - 1 from cn a join rn b on a.conv_id = b.conv_id and a.i = b.i
                         where a.conv_id = ids.conv_id and (a.role <> b.role or a.text <> b.text)), least(nc, nr)) as n_common from ids),
sides as (select 0 as side, * from cn union all select 1, * from rn),
cut as (
  select s.side, s.conv_id, s.i, s.role = 'assistant' as train, s.i <= m.n_common as common,
         '<|' || s.role || '|>' || chr(10) || s.text || '<|end|>' || chr(10) as shown, length(s.role) + 5 as head
  from sides s join same m on m.conv_id = s.conv_id),
placed as (select *, coalesce(sum(length(shown)) over (partition by side, conv_id, common order by i rows between unbounded preceding and 1 preceding), 0) as pos from cut),
texts as (
  select side, conv_id, common, string_agg(shown, '' order by i) as shown,
         string_agg(case when train then pos || ':' || head || ':0,' || (pos + head) || ':' || (length(shown) - head) || ':1' else pos || ':' || length(shown) || ':0' end, ',' order by i) as mask
  from placed group by side, conv_id, common)
select m.conv_id, cast(m.n_common as int) as n_common, coalesce(p.shown, '') as prompt, coalesce(a.shown, '') as chosen, coalesce(b.shown, '') as rejected,
       coalesce(a.mask, '') as chosen_mask, coalesce(b.mask, '') as rejected_mask,
       case when nc = 0 or nr = 0 then 'one_sided' when nc = n_common and nr = n_common then 'identical' else 'pair' end as status
from same m left join texts p on p.conv_id = m.conv_id and p.side = 0 and p.common
     left join texts a on a.conv_id = m.conv_id and a.side = 0 and not a.common left join texts b on b.conv_id = m.conv_id and b.side = 1 and not b.common
"""

OP12 = r"""
with recursive src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), '') as letters from conversations),
hashed as (
  select *, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(letters, lambda c: [cast(ascii(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda a, x: case when x >= 0 then xor(a, x) else xor(a // 2, 3988292384 * (a % 2)) end)) % 20 as fault from src),
turns as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
         case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hashed, unnest(range(case when fault = 3 then 2 else 1 end)) as t(copy) where fault <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') as said from turns),
known as (
  select *, lag(role) over (partition by conv_id order by i) as before, row_number() over (partition by conv_id, role, text order by i) as seen from placed),
named as (
  select *, case when said = '' then 'blank' when seen > 1 then 'duplicate' when right(said, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from known),
counts as (
  select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (i > 1 and left(before, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal from named group by conv_id),
inserts as (select * from (values (0, 0, 0, '', cast([] as varchar[])), (0, 5, 2, 'I', ['user:']), (0, 10, 3, 'II', ['user:', 'assistant:']),
  (1, 0, 1, '', []), (1, 5, 2, 'I', ['user:']), (1, 10, 3, 'II', ['user:', 'assistant:']), (2, 0, 2, '', []), (2, 5, 3, 'I', ['assistant:']),
  (2, 10, 2, 'II', ['assistant:', 'user:']), (3, 0, 3, '', []), (3, 5, 2, 'I', ['user:']), (3, 10, 3, 'II', ['user:', 'assistant:'])) as t(state, price, opened, letters, lines)),
moves as (select * from (values (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2),
  (0, 'R', '', 2), (1, 'R', '', 2), (2, 'R', '', 3), (3, 'R', '', 2), (0, 'D', '', 0), (1, 'D', '', 1), (2, 'D', '', 2), (3, 'D', '', 3)) as t(opened, edit, initial, state)),
search as (
  select conv_id, 0 as i, 0 as state, {'cost': 0, 'audit': '', 'lines': cast([] as varchar[])} as best from counts
  union all
  select conv_id, i, state, min(found) from (
    select s.conv_id, r.i, m.state, {'cost': s.best.cost + g.price + case m.edit when 'D' then 2 when 'R' then 1 else 0 end
             + case when m.edit <> 'D' and r.fault = 'truncated' then 5 else 0 end,
           'audit': s.best.audit || g.letters || m.edit,
           'lines': s.best.lines || g.lines || case m.edit when 'D' then [] when 'K' then [r.role || ':' || r.text]
             else [case m.state when 2 then 'user:' else 'assistant:' end || r.text] end} as found
    from search s join named r on r.conv_id is not distinct from s.conv_id and r.i = s.i + 1 join inserts g on g.state = s.state
         join moves m on m.opened = g.opened and (m.edit = 'D' or r.fault in ('', 'truncated')) and (m.edit <> 'K' or m.initial = left(r.role, 1)))
  group by conv_id, i, state),
ended as (
  select c.conv_id, min({'cost': s.best.cost + g.price, 'audit': s.best.audit || g.letters, 'lines': s.best.lines || g.lines}) as best
  from counts c join search s on s.conv_id is not distinct from c.conv_id and s.i = c.n join inserts g on g.state = s.state and g.opened in (0, 3) group by c.conv_id)
select o.conv_id, coalesce(c.gaps, 0) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated,
       coalesce(c.illegal, 0) as illegal, cast(coalesce(e.best.cost, 0) as bigint) as cost, coalesce(e.best.audit, '') as audit,
       sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id
     left join ended e on e.conv_id is not distinct from o.conv_id
"""
