"""DuckDB SQL for the queries that SQL can express."""

OP5 = r"""with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parsed as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
ruled as (select *, case when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
  when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
  when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
  when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
  when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule from parsed),
judged as (select *, case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' when rule is not null then 'allow' end as ruled from ruled),
hosts as (select host, count(ruled)::double as n, count(*) filter (ruled = 'block')::double as k, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain, array_to_string(list_slice(string_split(host, '.'), -1, -1), '.') as suffix from judged group by host),
domains as (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(k) as k from domains group by all),
total as (select (sum(k) + 0.5) / (sum(n) + 1.0) as m, sum(n) + 1.0 as known from suffixes),
s1 as (select suffix, n, k, m as parent, known from suffixes, total),
z1 as (select sum(pow(k - n * parent, 2)) as s, sum(n * parent * (1 - parent)) as b, sum(n * (n - 1) * parent * (1 - parent)) as p from s1 where n > 0),
w1 as (select case when coalesce(s, 0) = 0 or coalesce(p, 0) = 0 then 10.0 when s > b then least(greatest(p / (s - b) - 1, 1.0), 1000.0) else 1000.0 end as fitted from z1),
p1 as (select suffix, n, k, parent, least(fitted, known) as w from s1, w1),
s2 as (select d.domain, d.n, d.k, (p1.k + w * parent) / (p1.n + w) as parent, p1.n + w as known from domains d join p1 using (suffix)),
z2 as (select sum(pow(k - n * parent, 2)) as s, sum(n * parent * (1 - parent)) as b, sum(n * (n - 1) * parent * (1 - parent)) as p from s2 where n > 0),
w2 as (select case when coalesce(s, 0) = 0 or coalesce(p, 0) = 0 then 10.0 when s > b then least(greatest(p / (s - b) - 1, 1.0), 1000.0) else 1000.0 end as fitted from z2),
p2 as (select domain, n, k, parent, least(fitted, known) as w from s2, w2),
s3 as (select h.host, h.n, h.k, (p2.k + w * parent) / (p2.n + w) as parent, p2.n + w as known from hosts h join p2 using (domain)),
z3 as (select sum(pow(k - n * parent, 2)) as s, sum(n * parent * (1 - parent)) as b, sum(n * (n - 1) * parent * (1 - parent)) as p from s3 where n > 0),
w3 as (select case when coalesce(s, 0) = 0 or coalesce(p, 0) = 0 then 10.0 when s > b then least(greatest(p / (s - b) - 1, 1.0), 1000.0) else 1000.0 end as fitted from z3),
p3 as (select host, n, k, parent, least(fitted, known) as w from s3, w3),
post as (select host, k + w * parent as a, n - k + w * (1 - parent) as b from p3),
known as (select host, a / (a + b) - 2.0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 as rejected from post)
select page_id, j.host, path, rule, coalesce(ruled, case when rejected then 'block' else 'allow' end) as verdict from judged j join known using (host)"""

OP9 = r"""with docs as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
lines as (select r, unnest(string_split(text, chr(10))) as line from docs),
dups as (select r, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
windows as (select r, i, list_slice(w, i, i + 7) as win from (select r, w, unnest(range(1, len(w) - 6)) as i from docs where len(w) >= 8)),
twice as (select r, i from (select r, i, count(*) over (partition by r, win) as c from windows) where c > 1),
covered as (select r, count(distinct i + j) as n from twice, range(0, 8) t(j) group by r),
counted as (select d.r, doc_id, source, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  coalesce(dups.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words from docs d left join dups on dups.r = d.r left join covered on covered.r = d.r),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counted),
hosts as (select source, count(*)::double as n, count(*) filter (base_failed)::double as k from judged group by source),
m as (select count(*) as hosts, sum(n) as n, sum(k) as k, sum(n * n) as nn, sum(k * k / n) as s2, (sum(k) + 0.5) / (sum(n) + 1.0) as mean from hosts),
e as (select *, (s2 - k * k / n - (hosts - 1) * mean * (1 - mean)) / greatest(n - nn / n, 1e-9) as excess from m),
s as (select mean, case when hosts < 2 then 50.0 when excess > 0 then least(greatest(mean * (1 - mean) / excess - 1, 2.0), 1000.0) else 1000.0 end as strength from e),
post as (select source, k + mean * strength as a, n - k + (1 - mean) * strength as b from hosts, s),
bad as (select source, a / (a + b) - 3.0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 as rejected from post)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected as kept from judged j join bad on bad.source is not distinct from j.source"""
