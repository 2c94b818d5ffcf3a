"""SQL that recomputes the catalogue's queries on the same tables, for checking."""

from __future__ import annotations

from postledger.functions.flags import HUMAN_CHECK_PHRASES
from postledger.functions.tokens import SHORT_TERMS, STOP_WORDS, TOKEN_PATTERN
from postledger.functions.text import FALSE_WORDS, JS_SPACE, PY_SPACE, TRUE_WORDS
from postledger.operators.reports import EXPORT_LIMIT
from postledger.plans.catalogue import (
    COMPANY_FRAGMENTS,
    MERGE_COMPANIES,
    MERGE_TITLES,
    TITLE_WORDS,
    MATCH_SCORE,
    MATCH_SCORE_REQUIRED,
)
from postledger.plans.fixtures import REQUIRED


def _words(values: list[str]) -> str:
    return ", ".join(f"'{value}'" for value in values)


def squeeze(e: str) -> str:
    return f"trim(regexp_replace(coalesce({e}, ''), '{PY_SPACE}+', ' ', 'g'))"


def clean(e: str) -> str:
    return f"trim(regexp_replace(coalesce({e}, ''), '{JS_SPACE}+', ' ', 'g'))"


def strip(e: str) -> str:
    return f"regexp_replace(coalesce({e}, ''), '^{PY_SPACE}+|{PY_SPACE}+$', '', 'g')"


def key(e: str) -> str:
    return (
        f"replace(replace(upper(translate({squeeze(e)}, 'ıKÅΩϴ', 'KÅΩΘ')), "
        "'ẞ', 'SS'), 'İ', 'İ')"
    )


def iso(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def tokens(e: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({e}, '{TOKEN_PATTERN}', 0), lambda x: trim(lower(x), '.-')), "
        f"lambda x: x not in ({_words(STOP_WORDS)}) and (length(x) > 2 or x in ({_words(SHORT_TERMS)})))"
    )


def no_case(e: str) -> str:
    return f"translate({e}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


HEADLINE = "nullif(trim(substr(split_part(d.text, chr(10), 1), 1, 80)), '')"

POSTINGS = f"""postings as (
  select d.source, concat('doc-', cast(d.doc_id as varchar)) as source_id, {HEADLINE} as title,
         case when d.doc_id % 50 <> 0 then s.s_name end as company, d.lang as location, p.url, d.text as description,
         case d.doc_id % 4 when 0 then 'Yes' when 1 then 'onsite' when 2 then '' else 'maybe' end as remote,
         d.doc_id as pos
  from documents d
  left join supplier s on s.s_suppkey = d.doc_id % (select count(*) from supplier)
  left join pages p on p.page_id = d.doc_id % (select count(*) from pages))"""

LANDED = f"""landed as (
  select case when d.doc_id % 13 <> 0
              then 'c-' || cast(d.n_chars % ((select count(*) from documents) * 2 // 5) as varchar) else '' end as source_id,
         {strip("coalesce(" + HEADLINE + ", '')")} as title,
         case when d.doc_id % 50 <> 0 then s.s_name else '' end as company, d.lang as location,
         {strip("case when d.doc_id % 11 = 0 then '' when d.doc_id % 17 = 0 then p.url || '//' when d.doc_id % 3 = 0 then p.url || '/' else p.url end")} as url,
         case when d.doc_id % 5 = 0 then 'Easy  Apply ' else '' end || d.text as description, d.doc_id as pos
  from documents d
  left join supplier s on s.s_suppkey = d.doc_id % (select count(*) from supplier)
  left join pages p on p.page_id = (d.doc_id * 31) % (select count(*) from pages))"""

STORED = """stored_landing as (
  select 'e-' || cast(g.page_id as varchar) as source_id, 'Stored' as title, s.s_name as company, g.url, g.page_id as pos
  from pages g left join supplier s on s.s_suppkey = g.page_id % (select count(*) from supplier)
  where g.url like '%.html' or g.url like '%/'),
stored_keys as (
  select 'c-' || cast(s.s_suppkey as varchar) as source_id, g.url
  from supplier s left join pages g on g.page_id = s.s_suppkey where s.s_acctbal < 0)"""

SIGHTINGS = """sightings as (
  select event_type as source, concat(cast(user_id as varchar), '-', cast(hour(ts) as varchar)) as source_id,
         ts as seen_at, event_id as pos, props as title, 'Company ' || cast(user_id % 37 as varchar) as company,
         case user_id % 3 when 0 then 'https://www.LinkedIn.com/' when 1 then 'https://x.indeed.ch/' else 'https://else.org/' end
           || cast(user_id as varchar) as url,
         value as match_score
  from events)"""

FOLD = """fold as (
  select source, source_id, count(*) as seen_count, min(seen_at) as first_seen_at, max(seen_at) as last_seen_at,
         max(pos) filter (where last_one) as last_pos, max(pos) filter (where first_one) as first_pos, max(title) filter (where last_one) as title,
         max(company) filter (where last_one) as company, max(url) filter (where last_one) as url,
         max(match_score) filter (where last_one) as match_score
  from (select *, row_number() over (partition by source, source_id order by seen_at desc, pos desc) = 1 as last_one,
               row_number() over (partition by source, source_id order by seen_at, pos) = 1 as first_one
        from sightings) group by source, source_id)"""

SCAN_DAYS = """scan_days as (
  select event_type as source, cast(ts as date) as scan_day, min(ts) as started_at, max(ts) as finished_at,
         case when day(cast(ts as date)) % 7 = 0 then 'timeout' end as error
  from events group by event_type, cast(ts as date))"""

SITE = """case source when 'indeed' then 'Indeed' when 'job-ch' then 'job.ch' else
  case when url ilike '%linkedin.com%' or source_id ilike 'linkedin-%' then 'LinkedIn'
       when url ilike '%indeed.%' or source_id ilike 'indeed-%' then 'Indeed' else source end end as website,
  case when url ilike '%linkedin.com%' or source_id ilike 'linkedin-%' then url else '' end as linkedin,
  case when source = 'indeed' or url ilike '%indeed.%' or source_id ilike 'indeed-%' then url else '' end as indeed"""

LEDGER = f"""{SIGHTINGS}, {FOLD}, {SCAN_DAYS},
jobs as (select *, {SITE}, 'new' as status,
                last_pos as id from fold),
since as (select max(started_at) as s from scan_days where error is null),
since_of as (select source, max(started_at) as s from scan_days where error is null group by source)"""


def _new(bound: str) -> str:
    return f"(seen_count = 1 and first_seen_at >= coalesce({bound}, timestamp '0001-01-01'))"


LATEST = _new("(select s from since)")
RANK_ORDER = (
    f"first_seen_at desc, {no_case('company')}, {no_case('title')}, {no_case('website')}, last_seen_at desc, source, source_id"
)
RANKED_COLUMNS = f"""id, website, source_id, title, company, linkedin, indeed, cast(null as varchar) as location, source,
  cast(null as varchar) as posted_at, {iso('first_seen_at')} as first_seen_at, {iso('last_seen_at')} as last_seen_at,
  seen_count, match_score, status, url"""


# --- matching -----------------------------------------------------------------

CV = "cv as (select arg_min(text, item_id) as body from benchmark)"


def _top(source: str, who: str) -> str:
    """Ranked tokens per text: most frequent first, then earliest."""
    return f"""words as (
  select {who} as who, part, place, tok from (
    select {who}, part, unnest(toks) as tok, generate_subscripts(toks, 1) as place
    from (select *, {tokens('body')} as toks from ({source})))),
counted as (select who, tok, count(*) as n, min(part * 10000000 + place) as p from words group by who, tok),
top as (select * from (select *, row_number() over (partition by who order by n desc, p) as r from counted) where r <= 60)"""


def _required_front() -> list[str]:
    """Required words by last mention."""
    lowered = [word.lower() for word in REQUIRED]
    return [w for i, w in enumerate(lowered) if w not in lowered[i + 1:]]


def _scored(with_required: bool) -> str:
    required = [word.lower() for word in REQUIRED] if with_required else []
    req = f"[{_words(required)}]" if required else "cast([] as varchar[])"
    front = f"[{_words(_required_front())}]" if required else "cast([] as varchar[])"
    score = (
        "0.7 * len(list_filter(req, lambda x: list_contains(found, x))) / len(req) + 0.3 * len(matched) / len(kws)"
        if required
        else "len(matched) / len(kws)"
    )
    if required:
        score = "(len(list_filter(req, lambda x: list_contains(found, x))) / len(req)) * 0.7::double + (len(matched) / len(kws)) * 0.3::double"
        missing = "list_sort(list_filter(req, lambda x: not list_contains(found, x)))"
    else:
        missing = "list_filter(kws[1:10], lambda x: not list_contains(found, x))"
    return f"""with {POSTINGS}, {CV}, {_top("select 0 as one, 0 as part, body from cv", "one")},
profile as (select list_concat(list_filter({front}, lambda x: not list_contains(k, x)), k) as kws, {req} as req
            from (select list(tok order by r) as k from top)),
found as (select source_id, source, company, list_distinct({tokens("concat_ws(' ', title, company, location, description)")}) as found from postings),
hits as (select f.*, p.kws, p.req, list_sort(list_filter(p.kws, lambda x: list_contains(f.found, x))) as matched
         from found f, profile p),
scored as (select source_id, source, company, round_even(({score}) * 100, 2) as match_score,
       array_to_string(matched[1:25], ',') as matched_keywords,
       array_to_string({missing}[1:25], ',') as missing_keywords from hits)"""


def _pairs(source: str, required: bool) -> str:
    front = f"[{_words(_required_front())}]" if required else "cast([] as varchar[])"
    req = f"[{_words([w.lower() for w in REQUIRED])}]" if required else "cast([] as varchar[])"
    return f"""with {POSTINGS}, {_top(source, "who_id")},
profile as (select who, list_concat(list_filter({front}, lambda x: not list_contains(k, x)), k) as kws, {req} as req
            from (select who, list(tok order by r) as k from top group by who)),
kw as (select who, len(kws) as nk, len(req) as nr, tok,
              len(list_filter(req, lambda x: x = tok)) as times from (select *, unnest(kws) as tok from profile)),
found as (select source_id, unnest(list_distinct({tokens("concat_ws(' ', title, company, location, description)")})) as tok from postings),
hit as (select source_id, who, nk, nr, count(*) as n, sum(times) as rn from found join kw using (tok) group by 1, 2, 3, 4)
select source_id, who as profile_id, n as n_matched,
       round_even((case when nr > 0 then (rn / nr) * 0.7::double + (n / nk) * 0.3::double else n / nk end) * 100, 2) as match_score
from hit"""


def _above(pairs: str, least: float) -> str:
    return f"select * from ({pairs}) where match_score >= {least}"


def _best(pairs: str, k: str) -> str:
    return f"""select source_id, profile_id, rank, n_matched, match_score from (
  select *, row_number() over (partition by profile_id order by match_score desc, source_id) as rank from ({pairs}) where match_score > 0)
where rank <= {k}"""


# --- exclusion and merging ------------------------------------------------------

_FRAGMENTS = [f for f in COMPANY_FRAGMENTS if f.strip()]
EXCLUDED = " or ".join(f"contains({key('company')}, {key(chr(39) + f + chr(39))})" for f in _FRAGMENTS)
BY_TABLE = f"""with {POSTINGS}, frag as (select {key("upper(substr(s_name, 9, 30))")} as k from supplier where s_acctbal < 2000)
select source_id, company from postings
where not exists (select 1 from frag where k <> '' and contains({key('company')}, k))"""


def _plain(title: str, words: list[str]) -> str:
    return " or ".join(f"contains(lower({title}), '{w.lower()}')" for w in words if w)


def _by_word(title: str, words: list[str]) -> str:
    parts = []
    for word in (w.strip().lower() for w in words):
        if word == "intern":
            parts.append(rf"regexp_matches(lower({title}), '\bintern(?:s|ship)?\b')")
        elif word:
            parts.append(f"contains(lower({title}), '{word}')")
    return " or ".join(parts)


MERGE_OUT = " or ".join(f"contains({key('company')}, {key(chr(39) + f + chr(39))})" for f in MERGE_COMPANIES)


def _rules(complete: str, titles: bool, easy: bool) -> str:
    steps = [f"when not ({complete}) then 'skipped'", f"when {MERGE_OUT} then 'excluded'"]
    if titles:
        steps.append(f"when {_by_word('title', MERGE_TITLES)} then 'excluded'")
    if easy:
        steps.append(r"when not regexp_matches(description, '(?i)\beasy\s+apply\b') then 'excluded'")
    return f"case {' '.join(steps)} end as decision"


def _greedy(candidates: str, known_id: str, known_url: str, exact: bool) -> str:
    """Row by row in arrival order, with the lists of used ids and urls."""
    checks = "[c.url]" if exact else "c.variants"
    variants = "[url]" if exact else (
        "case when ends_with(url, '/') then [url, rtrim(url, '/')] else [url, rtrim(url, '/'), url || '/'] end"
    )
    return f"""cand as (select *, row_number() over (order by pos) as rn from (
  select pos, source_id, url, {variants} as variants,
         source_id in ({known_id}) or (url <> '' and {known_url}) as known
  from {candidates})),
step as (
  select cast(0 as bigint) as rn, cast(null as bigint) as pos, false as kept,
         cast([] as varchar[]) as ids, cast([] as varchar[]) as urls
  union all
  select rn, pos, ok, case when ok then list_append(ids, source_id) else ids end,
         case when ok and url <> '' then list_append(urls, url) else urls end
  from (select c.rn, c.pos, c.source_id, c.url, s.ids, s.urls,
               not c.known and not list_contains(s.ids, c.source_id)
               and (c.url = '' or not list_has_any({checks}, s.urls)) as ok
        from step s join cand c on c.rn = s.rn + 1)),
kept as (select pos from step where kept)"""


def _merged(easy: bool) -> str:
    return f"""with recursive {LANDED}, {STORED},
kept_old as (select * from stored_landing where not ({MERGE_OUT})),
known_ids as (select source_id from kept_old union select source_id from stored_keys),
known_urls as (select rtrim(url, '/') as u from kept_old where url is not null union
               select rtrim(url, '/') from stored_keys where url is not null),
ruled as (select *, {_rules("source_id <> '' and title <> '' and company <> ''", True, easy)} from landed),
{_greedy("ruled where decision is null", "select source_id from known_ids", "rtrim(url, '/') in (select u from known_urls)", False)},
decisions as (select pos, source_id, url, title, company, coalesce(decision, case when pos in (select pos from kept) then 'imported' else 'skipped' end) as decision
              from ruled)"""


EXACT_ID = "case when source_id <> '' then source_id else 'manual-' || substr(sha256(case when url <> '' then url else concat_ws('|', title, company, location) end), 1, 16) end"
EXACT = f"""with recursive {LANDED}, {STORED},
kept_old as (select * from stored_landing where not ({MERGE_OUT})),
named as (select * replace ({EXACT_ID} as source_id) from landed),
ruled as (select *, {_rules("title <> '' and company <> ''", False, False)} from named),
{_greedy("ruled where decision is null", "select source_id from kept_old", "url in (select url from kept_old)", True)}
select pos, source_id, url, coalesce(decision, case when pos in (select pos from kept) then 'imported' else 'skipped' end) as decision
from ruled"""

# The plain operator works on the rows as landed, so the url is not stripped for output.
TWO_KEYS = f"""with recursive {LANDED}, {_greedy("landed where source_id <> ''", "select ''", "false", False)}
select l.pos, l.source_id, l.url from landed l join kept using (pos)"""


# --- scalar functions -----------------------------------------------------------

def _text_hash(e: str) -> str:
    units = (
        f"flatten(list_transform(list_transform(string_split({e}, ''), lambda c: unicode(c)), "
        "lambda u: case when u < 0 then cast([] as integer[]) when u < 65536 then [u] "
        "else [55296 + ((u - 65536) >> 10), 56320 + ((u - 65536) & 1023)] end))"
    )
    return (
        f"lower(to_hex(list_reduce(list_prepend(cast(5381 as bigint), list_transform({units}, lambda u: cast(u as bigint))), "
        "lambda h, u: xor(h * 33, u) & 4294967295)))"
    )


_ORIGIN = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1))"


# --- pages --------------------------------------------------------------------------

def _page_cards(site: str) -> str:
    numbered = site == "linkedin"
    prefix = f"{site}-"
    origin = "https://jobs.example.com"
    if numbered:
        url = f"case when slot = 8 then '{origin}/jobs/view/x' || job else 'https://www.linkedin.com/jobs/view/' || job || '/' end"
        remote = "note = 'REMOTE work'"
    else:
        url = f"case when slot = 8 then '{origin}/viewjob?pos=' || job else '{origin}/viewjob?jk=' || job end"
        remote = "note <> 'remotely'"
    # Headlines may hold the words themselves.
    pattern = "remote" if numbered else "remote|home office"
    return f"""cards as (
  select cast(doc_id // 10 as varchar) as page_key, doc_id % 10 as slot,
         case when doc_id % 10 = 9 then cast(doc_id // 10 * 10 as varchar) else cast(doc_id as varchar) end as job,
         {clean("coalesce(" + HEADLINE + ", '')")} as headline, d.source || ' & Co' as company, d.lang as location,
         case doc_id % 3 when 0 then 'REMOTE work' when 1 then 'Home Office, easy apply' else 'remotely' end as note
  from documents d),
shaped as (select page_key, slot, job, note, company, location,
                  trim(headline || ' ' || company || ' ' || location || ' ' || note) as description,
                  case when headline <> '' then headline else company end as title, {url} as url
           from (select * replace (case when headline = '' then '' else headline end as headline) from cards)),
records as (select page_key, cast(slot as integer) as "at",
  case when slot = 8 then '{prefix}' || {_text_hash("concat_ws('|', title, company, url)")} else '{prefix}' || job end as source_id,
  title, company, location, url, description, 'last-24h' as posted_at,
  case when {remote} or regexp_matches(concat_ws(' ', title, location, description), '(?i)\\b(?:{pattern})\\b') then 'true' else '' end as remote,
  case when regexp_matches(description, '(?i)\\beasy\\s+apply\\b') then 'true' else '' end as easy_apply from shaped),
found as (select page_key, source_id, min("at") as "at", arg_max(title, "at") as title, arg_max(company, "at") as company,
  arg_max(location, "at") as location, arg_max(url, "at") as url, arg_max(description, "at") as description,
  max(posted_at) as posted_at, arg_max(remote, "at") as remote, arg_max(easy_apply, "at") as easy_apply
  from records group by page_key, source_id)"""


def _page_counts(site: str) -> str:
    return f"""with {_page_cards(site)}
select page_key, 'https://jobs.example.com/search?q=1' as url, count(*) as n_records, cast(page_key as bigint) % 3 = 0 as blocked
from found group by page_key"""


def _decoded(text: str) -> str:
    """The named references that the pages hold, & last."""
    for name, plain in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{plain}')"
    return text


# Elements that are not shown go one kind after the other, then comments, then tags.
_SHOWN = "regexp_replace(html, '(?is)^.*?<body[^>]*>', ' ')"
for _name in ("script", "style", "template", "noscript"):
    _SHOWN = f"regexp_replace({_SHOWN}, '(?is)<{_name}\\b.*?</{_name}\\s*>', ' ', 'g')"
_SHOWN = f"regexp_replace({_SHOWN}, '(?s)<!--.*?-->', ' ', 'g')"
_VISIBLE = clean(_decoded(f"regexp_replace({_SHOWN}, '(?s)<[^>]*>', ' ', 'g')"))


# --- applications ------------------------------------------------------------------

REPLAYED = """jobs as (select s_suppkey as id, cast(s_nationkey as bigint) as company_id, s_name as title, 'new' as status from supplier),
old as (select s_suppkey as job_id, cast(0 as bigint) as company_id, 'old position' as position, 'applied' as status,
               timestamp '2023-06-01 08:00:00' as moment, 'old' as notes from supplier where s_acctbal > 5000),
actions as (select user_id as job_id, case when event_type = 'click' then 'apply' else 'set_status' end as via,
  case event_type when 'purchase' then 'applied' when 'error' then 'discarded' when 'click' then 'interview' else 'new' end as status,
  case when event_type <> 'purchase' then props end as notes, ts as moment, event_id as pos
  from events where event_type <> 'view'),
marked as (select *, via = 'set_status' and status <> 'applied' as is_reset from actions where job_id in (select id from jobs)),
islands as (select *, sum(case when is_reset then 1 else 0 end) over w as island,
                   row_number() over (partition by job_id order by moment desc, pos desc) as back
            from marked window w as (partition by job_id order by moment, pos rows between unbounded preceding and current row)),
ends as (select job_id, max(island) as island, max(status) filter (where back = 1) as final_status from islands group by job_id),
recs as (select i.job_id, min(i.moment) as first_at, max(i.moment) as last_at,
                arg_max(i.status, (i.moment, i.pos)) as status, max(i.notes) filter (where last_rec) as notes
         from (select *, row_number() over (partition by job_id, island, is_reset order by moment desc, pos desc) = 1 as last_rec from islands) i
         join ends e on e.job_id = i.job_id and e.island = i.island where not i.is_reset group by i.job_id),
apps as (select coalesce(o.job_id, r.job_id) as job_id,
  case when keep then o.company_id else j.company_id end as company_id,
  case when keep then o.position else j.title end as position,
  case when r.job_id is not null then r.status else o.status end as status,
  case when keep then o.moment else r.first_at end as applied_at,
  case when r.job_id is not null then r.notes else o.notes end as notes,
  case when keep then o.moment else r.first_at end as created_at,
  case when r.job_id is not null then r.last_at else o.moment end as updated_at
  from (select j.*, o.job_id is not null and coalesce(e.island, 0) = 0 as keep from jobs j
        left join old o on o.job_id = j.id left join ends e on e.job_id = j.id) j
  left join old o on o.job_id = j.id left join recs r on r.job_id = j.id
  where keep or r.job_id is not null),
now_jobs as (select j.id, j.title, coalesce(e.final_status, j.status) as status from jobs j left join ends e on e.job_id = j.id)"""

VIEW = "case when status in ('applied', 'discarded') then status else 'open' end"


# --- sources -------------------------------------------------------------------------

CSV_ROWS = f"""rows as (select *, case when pos % 3 <> 0 then source_id else url || '#' || cast(pos as varchar) end as sid,
  coalesce(nullif(title, ''), 'Untitled') as t, coalesce(nullif(company, ''), 'Unknown') as c from postings)"""

ANY_TITLE = _plain("t", TITLE_WORDS)
OUT_C = EXCLUDED.replace("coalesce(company, '')", "coalesce(c, '')")

SCANNED = f"""{POSTINGS},
csv_rows as (select 'manual' as source, source_id, coalesce(title, 'Untitled') as title, coalesce(company, 'Unknown') as company,
                    location, description from postings),
kept_csv as (select * from csv_rows where not ({EXCLUDED}) and not ({_plain('title', MERGE_TITLES)})),
kept_api as (select 'api' as source, source_id, coalesce(title, 'Untitled') as title, coalesce(company, 'Unknown') as company,
                    'Remote' as location, '' as description from postings where not (company is not null and ({EXCLUDED})))"""

_REQ = [w.lower() for w in REQUIRED]
SCAN_SCORED = f"""with {SCANNED}, {CV}, {_top("select 0 as one, 0 as part, body from cv", "one")},
profile as (select list_concat(list_filter([{_words(_required_front())}], lambda x: not list_contains(k, x)), k) as kws,
                   [{_words(_REQ)}] as req from (select list(tok order by r) as k from top)),
all_rows as (select *, 2 as seen_count, '2024-01-01T08:00:00.000Z' as first_seen_at from kept_csv
             union all select *, 2, '2024-01-02T08:00:00.000Z' from kept_api),
hits as (select a.*, kws, req, list_distinct({tokens("concat_ws(' ', title, company, location, description)")}) as found from all_rows a, profile)
select source, source_id, company, title, cast(seen_count as bigint) as seen_count, 'new' as status,
  round_even(((len(list_filter(req, lambda x: list_contains(found, x))) / len(req)) * 0.7::double
     + (len(list_filter(kws, lambda x: list_contains(found, x))) / len(kws)) * 0.3::double) * 100, 2) as match_score,
  first_seen_at, '2024-01-02T08:00:00.000Z' as last_seen_at from hits"""


ORACLES: dict[str, str] = {
    "top_matches": f"""{_scored(False)}
select source_id, source, company, match_score, matched_keywords from scored
where company is null or not ({EXCLUDED}) order by match_score desc, source_id limit 25""",
    "score_postings": f"{_scored(False)} select source_id, match_score, matched_keywords, missing_keywords from scored",
    "score_postings_required": f"{_scored(True)} select source_id, match_score, matched_keywords, missing_keywords from scored",
    "profile_keywords": f"""with {_top("select item_id, 0 as part, text as body from benchmark", "item_id")}
select b.item_id as profile_id,
  array_to_string(list_concat(list_filter([{_words(_required_front())}], lambda x: not list_contains(k, x)), k), ',') as keywords,
  '{",".join(_REQ)}' as required_keywords
from (select item_id, coalesce((select list(tok order by r) from top where who = item_id), cast([] as varchar[])) as k from benchmark) b""",
    "score_many_profiles": _pairs("select conv_id as who_id, turn as part, text as body from conversations", False),
    "score_many_profiles_by_shuffle": _pairs("select item_id as who_id, 0 as part, text as body from benchmark", True),
    "match_profiles": _above(_pairs("select conv_id as who_id, turn as part, text as body from conversations", False), MATCH_SCORE),
    "match_profiles_required": _above(_pairs("select item_id as who_id, 0 as part, text as body from benchmark", True), MATCH_SCORE_REQUIRED),
    "best_matches": _best(_pairs("select conv_id as who_id, turn as part, text as body from conversations", False), "profile_id % 4"),
    "token_frequency": f"select lang, tok as token, count(*) as n from (select lang, unnest({tokens('text')}) as tok from documents) group by lang, tok",
    "exclude_companies": f"with {POSTINGS} select source_id, company from postings where company is null or not ({EXCLUDED})",
    "exclude_companies_table": BY_TABLE,
    "exclude_companies_long_table": BY_TABLE,
    "exclude_titles": f"select p_partkey, ({_plain('p_name', TITLE_WORDS)}) as plain, ({_by_word('p_name', TITLE_WORDS)}) as by_word from part",
    "merge_decisions": f"{_merged(False)} select pos, source_id, url, decision from decisions",
    "merge_decisions_easy_apply": f"{_merged(True)} select pos, source_id, url, decision from decisions",
    "merge_counts": f"""{_merged(False)} select decision, cast(count(*) as bigint) as n from (
  select decision from decisions union all select 'excluded' from stored_landing where {MERGE_OUT}) group by decision""",
    "landing_rewrite": f"""{_merged(False)} select source_id, title, company, nullif(url, '') as url from decisions where decision = 'imported'
union all select source_id, title, company, url from kept_old""",
    "dedup_two_keys": TWO_KEYS,
    "import_exact_url": EXACT,
    "first_by_id": f"with {LANDED} select source_id, min(pos) as pos, arg_min(url, pos) as url from landed where source_id <> '' group by source_id",
    "last_by_id": f"""with {LANDED} select source_id, max(pos) as pos, min(pos) as first_pos, arg_max(url, pos) as url
from landed where source_id <> '' group by source_id""",
    "site_labels": """with p as (select page_id, case when page_id % 11 <> 0 then url end as url,
  case page_id % 10 when 0 then 'indeed' when 1 then 'job-ch' when 2 then 'mobile' else 'web' end as source,
  case page_id % 7 when 0 then 'BLOG-' when 1 then 'm-' else 'x-' end || cast(page_id as varchar) as id from pages)
select page_id,
  case source when 'indeed' then 'Indeed' when 'job-ch' then 'job.ch' else
    case when url ilike '%//blog.%' or id ilike 'blog-%' then 'Blog' when url ilike '%//m.%' or id ilike 'm-%' then 'Mobile' else source end end as website,
  case when url ilike '%//blog.%' or id ilike 'blog-%' then url else '' end as blog,
  case when source = 'mobile' or url ilike '%//m.%' or id ilike 'm-%' then url else '' end as mobile
from p""",
    "normalize_defaults": f"""with {POSTINGS} select source_id, coalesce(nullif(title, ''), 'Untitled') as title,
  coalesce(nullif({squeeze("'  ' || company || ' ' || chr(9) || ' x'")}, ''), 'Unknown') as company,
  {key('title')} as title_key,
  case when lower({strip('remote')}) in ({_words(TRUE_WORDS)}) then true when lower({strip('remote')}) in ({_words(FALSE_WORDS)}) then false end as remote,
  md5({clean('description')}) as clean_digest, md5({strip('description')}) as strip_digest,
  case when length(description) <= 70 then description else substr(description, 1, 67) || '...' end as short,
  lower({strip("coalesce(nullif(remote || ' ', ''), 'new')")}) as status, {no_case('title')} as title_order from postings""",
    "text_flags": r"""select doc_id, case when regexp_matches(text, '(?i)\b(?:la|the and)\b') then 'true' else '' end as remote,
  regexp_matches('easy  apply' || text, '(?i)\beasy\s+apply([^\pL\pN_]|$)') as easy_start, true as easy_flag from documents""",
    "url_keys": f"""with p as (select page_id, url, {_ORIGIN} as origin, regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) as path from pages)
select page_id, rtrim(url, '/') as url_key,
  array_to_string(list_sort(list_distinct([url, rtrim(url, '/'), case when ends_with(url, '/') then url else url || '/' end])), ' ') as variants,
  regexp_extract(url, '[?&]page=([^&#]*)', 1) as page_param, cast(page_id as varchar) as view_id,
  'https://www.linkedin.com/jobs/view/' || cast(page_id as varchar) || '/' as view_url, origin || path as resolved,
  case when contains(path, '#') then origin || path else origin || '/viewjob?jk=a%20b' || cast(page_id as varchar) end as keyed_url from p""",
    "hash_ids": f"""with {POSTINGS}, r as (select source_id, location, coalesce(title, '') as title, coalesce(company, '') as company,
  case when pos % 5 = 0 then '' else url end as url, case when pos % 4 = 0 then source_id else '' end as given from postings)
select source_id, case when given <> '' then given else 'manual-' || substr(sha256(case when url <> '' then url
  else concat_ws('|', title, company, location) end), 1, 16) end as content_id, {_text_hash("concat_ws('|', title, company, url)")} as text_hash from r""",
    "upsert_ledger": f"""with {SIGHTINGS}, {FOLD} select source, source_id, seen_count, {iso('first_seen_at')} as first_seen_at,
  {iso('last_seen_at')} as last_seen_at, first_pos, last_pos, title, match_score from fold""",
    "upsert_two_batches": f"""with {SIGHTINGS}, {FOLD} select source, source_id, seen_count, {iso('first_seen_at')} as first_seen_at,
  {iso('last_seen_at')} as last_seen_at, last_pos, title, match_score,
  case when day(last_seen_at) > 15 then 'applied' else 'new' end as status from fold""",
    "ledger_tables": f"""with {SIGHTINGS}, {FOLD},
half as (select *, day(seen_at) > 15 as late from sightings),
firsts as (select company, late, seen_at, pos from (select *, row_number() over (partition by company order by seen_at, pos) as r from half) where r = 1),
companies as (select company, row_number() over (order by seen_at, pos) as company_id from firsts),
part_last as (select source, source_id, late, min(seen_at) as f, arg_min(pos, (seen_at, pos)) as fp from half group by source, source_id, late),
born as (select source, source_id, f, fp, late from (select *, row_number() over (partition by source, source_id order by f) as r from part_last) where r = 1),
ids as (select source, source_id, row_number() over (order by late, f, fp) as id from born)
select id, source, source_id, company_id, company, title, {iso('first_seen_at')} as first_seen_at, {iso('last_seen_at')} as last_seen_at,
  seen_count, 'new' as status, match_score from fold join ids using (source, source_id) join companies using (company)""",
    "company_dimension": f"""with {POSTINGS}, named as (select coalesce(nullif({squeeze('company')}, ''), 'Unknown') as name, pos, location = 'en' as early from postings),
firsts as (select name, not bool_or(early) as late, coalesce(min(pos) filter (where early), min(pos)) as p from named group by name)
select row_number() over (order by late, p) as id, name from firsts""",
    "sighting_counts": f"""with {SIGHTINGS}, known as (select distinct source, source_id from sightings where day(seen_at) <= 15),
late as (select s.source, s.source_id, k.source is null as fresh from sightings s left join known k using (source, source_id) where day(seen_at) > 15)
select source, count(*) as found_count, count(distinct source_id) filter (where fresh) as new_count,
  count(*) - count(distinct source_id) filter (where fresh) as updated_count from late group by source""",
    "scan_log": f"""with {SIGHTINGS}, {SCAN_DAYS},
ranked as (select source, cast(seen_at as date) as scan_day, row_number() over (partition by source, source_id order by seen_at, pos) = 1 as fresh from sightings),
counts as (select source, scan_day, count(*) as found_count, count(*) filter (where fresh) as new_count from ranked group by source, scan_day)
select d.source, cast(d.scan_day as varchar) as scan_day, {iso('d.started_at')} as started_at, {iso('d.finished_at')} as finished_at, d.error,
  found_count, new_count, found_count - new_count as updated_count from scan_days d join counts using (source, scan_day)""",
    "scan_failures": f"""with {SCAN_DAYS} select source, bool_or(error is not null) as failed from scan_days group by source
union all select 'any', bool_or(error is not null) from scan_days""",
    "new_in_latest_scan": f"""with {LEDGER} select website, source, source_id, title, company, linkedin, indeed, url, {iso('first_seen_at')} as first_seen_at
from jobs where {LATEST} order by jobs.first_seen_at desc, source, source_id limit {EXPORT_LIMIT}""",
    "new_in_latest_scan_of_source": f"""with {LEDGER} select website, source, source_id, title, company, linkedin, indeed, url, {iso('first_seen_at')} as first_seen_at
from jobs where source = 'purchase' and {_new("(select s from since_of where source = 'purchase')")}
order by jobs.first_seen_at desc, source, source_id limit 100""",
    "ranked_jobs": f"""with {LEDGER}, listed as (select * from jobs order by {LATEST} desc, {RANK_ORDER} limit 25) select {RANKED_COLUMNS} from listed""",
    "ranked_jobs_filtered": f"""with {LEDGER}, listed as (select * from jobs where match_score >= 20 and status = 'new' and source = 'click'
order by {_new("(select s from since_of where source = 'click')")} desc, {RANK_ORDER} limit {EXPORT_LIMIT}) select {RANKED_COLUMNS} from listed""",
    "report_flags": f"""with {LEDGER}, listed as (select * from jobs order by {LATEST} desc, {RANK_ORDER} limit {EXPORT_LIMIT}),
fresh as (select distinct source_id from (select * from jobs where {LATEST} order by first_seen_at desc, source, source_id limit {EXPORT_LIMIT}))
select website, source_id, company, title, linkedin, indeed, url, source_id in (select source_id from fresh) as is_new,
  match_score > 40 as is_applied, website || ':' || source_id as job_key, case when match_score > 40 then 'applied' else 'new' end as status from listed""",
    "export_csv": f"""with {LEDGER} select website, source_id, company, title, linkedin, indeed, url
from jobs order by {LATEST} desc, {RANK_ORDER} limit {EXPORT_LIMIT}""",
    "application_state": f"""with {REPLAYED} select job_id, company_id, position, status, {iso('applied_at')} as applied_at, notes,
  {iso('created_at')} as created_at, {iso('updated_at')} as updated_at from apps""",
    "job_status": f"with {REPLAYED} select id, status from now_jobs",
    "unknown_jobs": f"with {REPLAYED} select job_id, pos from actions where job_id not in (select id from jobs)",
    "applications_report": f"""with {REPLAYED} select job_id, n_name as company, position, status, {iso('applied_at')} as applied_at, notes, {iso('updated_at')} as updated_at
from apps join nation on n_nationkey = company_id order by apps.updated_at desc, job_id limit 50""",
    "status_view_counts": f"""with {REPLAYED} select {VIEW} as view, cast(count(*) as bigint) as n from now_jobs group by 1
union all select 'total', count(*) from now_jobs""",
    "discarded_view": f"with {REPLAYED} select id, title, true as is_new from now_jobs where status = 'discarded'",
    "status_validation": """select event_id as pos,
  case event_type when 'purchase' then 'applied' when 'error' then 'discarded' when 'click' then 'interview' else 'new' end as status,
  event_type <> 'click' as valid from events where event_type <> 'view'""",
    "constraint_violations": """select 'companies_name_unique' as rule, count(*) as n from (select s_name from supplier group by s_name having count(*) > 1)
union all select 'jobs_key_unique', count(*) from (select event_type, user_id from events group by all having count(*) > 1)
union all select 'applications_job_unique', count(*) from (select o_custkey from orders group by o_custkey having count(*) > 1)
union all select 'jobs_company_exists', count(*) from events where user_id not in (select s_suppkey from supplier)
union all select 'applications_job_exists', count(*) from orders where o_custkey not in (select event_id from events)
union all select 'applications_company_exists', count(*) from orders where o_custkey not in (select s_suppkey from supplier)
union all select 'jobs_not_null', count(*) from events where value <= 1 or props is null or user_id is null or event_type is null or ts is null""",
    "csv_source": f"""with {POSTINGS}, {CSV_ROWS} select 'manual' as source, sid as source_id, t as title, c as company, location,
  url || '#' || cast(pos as varchar) as url, md5(description) as description_digest, '2024-01-01' as posted_at,
  case remote when 'Yes' then true when 'onsite' then false end as remote
from rows where not ({ANY_TITLE}) and not ({OUT_C})""",
    "json_source": f"""with {POSTINGS} select 'api' as source,
  case when pos % 3 <> 0 then cast(pos as varchar) else url || '#' || cast(pos as varchar) end as source_id,
  coalesce(nullif(title, ''), 'Untitled') as title, coalesce(nullif(company, ''), 'Unknown') as company,
  case when location <> 'fr' then location else 'Remote' end as location, url || '#' || cast(pos as varchar) as url,
  md5(description) as description_digest, '2024-01-01' as posted_at, true as remote, 'b' as raw_tag from postings""",
    "feed_source": f"""with {POSTINGS}, r as (select *, location = 'en' as atom,
  {strip(r"regexp_replace(coalesce(title, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]', '', 'g')")} as t from postings)
select 'feed' as source, case when atom or pos % 3 = 0 then source_id else url end as source_id, coalesce(nullif(t, ''), 'Untitled') as title,
  case when atom then 'Nobody' else coalesce(nullif(company, ''), 'ignored?') end as company, url,
  md5(case when atom then 's' else location end) as description_digest, case when atom then '2024-01-01' end as posted_at from r""",
    "deep_feeds": f"""with {POSTINGS}, r as (select source_id, pos, url,
  {strip(r"regexp_replace(coalesce(title, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]', '', 'g')")} as t from postings)
select source_id, case when pos % 3 = 2 then 'Untitled' else coalesce(nullif(t, ''), 'Untitled') end as title, 'Unknown' as company,
  case when pos % 3 <> 2 then url end as url from r
union all select 'second', 'Untitled', 'Unknown', null from r where pos % 3 = 1""",
    "tab_results": f"""with {POSTINGS} select pos as "window", 0 as tab, "at", source_id, coalesce(title, '') as title, url
from postings, (values (0), (1)) v("at")""",
    "tab_errors": f"""with {POSTINGS} select pos as "window", 2 as tab, case when location = 'es' then 'oops ' || source_id else source_id end as message from postings""",
    "tab_summary": """select count(*) * 2 as tabs, count(*) as failed, count(*) filter (where lang = 'fr') as blocked, count(*) * 2 as rows from documents""",
    "page_records_numbered": f"with {_page_cards('linkedin')} select * from found",
    "page_records_keyed": f"with {_page_cards('indeed')} select * from found",
    "page_summary_numbered": _page_counts("linkedin"),
    "page_summary_keyed": _page_counts("indeed"),
    "page_flags": f"""select cast(page_id as varchar) as page_key, url, {clean(_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))} as title,
  ({" or ".join(f"contains(lower({_VISIBLE}), '{p}')" for p in HUMAN_CHECK_PHRASES)}) as blocked, md5({_VISIBLE}) as text_digest from pages""",
    "cv_files": "select item_id, md5(text) as digest from benchmark",
    "older_snapshot": f"with {SIGHTINGS} select distinct source, source_id, cast(1 as bigint) as seen_count, cast(-1 as bigint) as last_pos from sightings",
    "scan_twice": f"""with {SCANNED} select 'manual' as source, count(*) as found_count, cast(0 as bigint) as new_count, count(*) as updated_count, false as error from kept_csv
union all select 'api', count(*) * 2, count(*), count(*), false from kept_api
union all select 'bad', 0, 0, 0, true""",
    "scan_ledger": SCAN_SCORED,
    "incremental_scan": f"""with {SIGHTINGS}, {FOLD} select source, source_id, seen_count, {iso('first_seen_at')} as first_seen_at,
  {iso('last_seen_at')} as last_seen_at, first_pos, last_pos, title, match_score from fold""",
    "stream_ledger": f"""with {SIGHTINGS.replace("from events)", "from events where user_id % 37 <> 36)")}, {FOLD}
select source, source_id, company, title, {iso('first_seen_at')} as first_seen_at, {iso('last_seen_at')} as last_seen_at,
  seen_count, 'new' as status, cast(0 as double) as match_score from fold""",
    "stream_scans": f"""with {SIGHTINGS.replace("from events)", "from events where user_id % 37 <> 36)")},
n as (select count(distinct (source, source_id)) as k, count(distinct company) as c from sightings)
select source, 3 as scans, 3 as closed, count(*) as found_count, count(distinct source_id) as new_count,
  count(*) - count(distinct source_id) as updated_count, any_value(k) as top_id, any_value(k) as ids,
  any_value(c) as top_company, any_value(c) as names from sightings, n group by source""",
    "running_sightings": f"""with {SIGHTINGS}, {FOLD} select source, source_id, seen_count, {iso('first_seen_at')} as first_seen_at,
  {iso('last_seen_at')} as last_seen_at, title from fold""",
}
