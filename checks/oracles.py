"""DuckDB statements that compute the registered queries by plain means.

They are written from the operators' definitions: nested loops, pattern matches
and full sorts instead of the classes, grams and prunings of the Spark plans.
"""

from __future__ import annotations

import re

from checks import fixtures as fx
from jobweave.vocab import RankingWeights

_WS = r"[\t\n\x0B\f\r \x{0085}\p{Z}]"
_W = r"[\p{L}\p{N}_]"
_NW = r"[^\p{L}\p{N}_]"


def _sql(statement: str) -> str:
    return statement.replace("{S}", "VARCHAR").strip()


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{_WS}+', ' ', 'g')")


def stable_hash(x: str) -> str:
    return f"sha256(lower({strip(x)}))"


def or_null(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def text_list(x: str) -> str:
    sep = f"CASE WHEN contains({x}, ';') THEN ';' ELSE ',' END"
    return (
        f"coalesce(list_filter(list_transform(string_split({x}, {sep}), lambda v: {strip('v')}),"
        " lambda v: v <> ''), [])"
    )


def first_seen(x: str) -> str:
    """Ordered distinct of a list expression."""
    return f"(SELECT coalesce(list(v ORDER BY i), []) FROM (SELECT v, min(i) AS i FROM (SELECT unnest({x}) AS v, generate_subscripts({x}, 1) AS i) GROUP BY v))"


def words(terms) -> str:
    """Pattern of an existence test for any of the terms as a whole word."""
    return f"(^|{_NW})(" + "|".join(terms) + f")($|{_NW})"


def url_parts(u: str) -> dict[str, str]:
    rx = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
    part = lambda i: f"regexp_extract({u}, '{rx}', {i})"
    return {"scheme": f"lower({part(1)})", "host": f"lower({part(2)})", "path": part(3), "query": part(4)}


def canonical(u: str) -> str:
    p = url_parts(strip(u))
    key = "split_part(x, '=', 1)"
    recode = lambda v: f"replace(url_encode(url_decode(replace({v}, '+', ' '))), '%20', '+')"
    pair = f"{recode(key)} || '=' || {recode(chr(40) + 'CASE WHEN contains(x, ' + q('=') + ') THEN regexp_replace(x, ' + q('^[^=]*=') + ', ' + q('') + ') ELSE ' + q('') + ' END' + chr(41))}"
    kept = (
        f"list_filter(string_split({p['query']}, '&'), lambda x: x <> '' AND NOT starts_with(lower({key}), 'utm_')"
        f" AND lower({key}) NOT IN ('fbclid','gclid','mc_cid','mc_eid','ref','source'))"
    )
    query = f"array_to_string(list_transform({kept}, lambda x: {pair}), '&')"
    path = f"regexp_replace({p['path']}, '/+$', '')"
    return (
        f"(CASE WHEN {p['scheme']} <> '' THEN {p['scheme']} || '://' ELSE '' END || {p['host']}"
        f" || CASE WHEN {path} = '' THEN '/' ELSE {path} END"
        f" || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)"
    )


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{n} AS ({s})" for n, s in ctes)
    return f"WITH {body}\n{final}"


# --- postings ---------------------------------------------------------------

NORMALIZED = f"""
SELECT ordinal, source, source_job_id, {strip('title')} AS title, {strip('company')} AS company,
  {strip('location')} AS location, {strip('description')} AS description, url, posted_date,
  {or_null('employment_type')} AS employment_type, {or_null('seniority')} AS seniority,
  {text_list('concentration_tags_text')} AS concentration_tags, {text_list('role_tags_text')} AS role_tags,
  opt_cpt_flag, created_at, updated_at
FROM postings_raw"""

VALID = f"""
SELECT * FROM normalized WHERE url <> '' AND {strip('source')} <> '' AND title <> ''
  AND company <> '' AND location <> '' AND description <> ''"""

KEYED = f"""
SELECT ordinal, {canonical('url')} AS key_url,
  CASE WHEN {or_null('source_job_id')} IS NOT NULL
       THEN {fold('source')} || chr(31) || {fold(strip('source_job_id'))} END AS key_source_id,
  sha256(concat_ws(chr(31), {fold('title')}, {fold('company')}, {fold('location')},
         {stable_hash(collapse(fold('description')))})) AS key_content
FROM valid"""

ROUNDS = 7


def dedup_ctes(source: str = "keyed", tag: str = "") -> list[tuple[str, str]]:
    """First-seen rule, unrolled: in every round the rows that come first on all
    their keys are kept and everything sharing a key with them is dropped."""
    out = [
        (
            f"u{tag}0",
            f"""SELECT ordinal, 'u:' || key_url AS k FROM {source}
                UNION ALL SELECT ordinal, 's:' || key_source_id FROM {source} WHERE key_source_id IS NOT NULL
                UNION ALL SELECT ordinal, 'c:' || key_content FROM {source}""",
        )
    ]
    for i in range(ROUNDS):
        out += [
            (f"m{tag}{i}", f"SELECT k, min(ordinal) AS m FROM u{tag}{i} GROUP BY k"),
            (
                f"w{tag}{i}",
                f"""SELECT u.ordinal FROM u{tag}{i} u JOIN m{tag}{i} m ON u.k = m.k
                    GROUP BY u.ordinal HAVING bool_and(u.ordinal = m.m)""",
            ),
            (
                f"d{tag}{i}",
                f"""SELECT DISTINCT ordinal FROM u{tag}{i} WHERE k IN
                    (SELECT k FROM u{tag}{i} WHERE ordinal IN (SELECT ordinal FROM w{tag}{i}))""",
            ),
            (
                f"u{tag}{i + 1}",
                f"SELECT * FROM u{tag}{i} WHERE ordinal NOT IN (SELECT ordinal FROM d{tag}{i})",
            ),
        ]
    out.append(
        (f"kept{tag}", " UNION ALL ".join(f"SELECT ordinal FROM w{tag}{i}" for i in range(ROUNDS)))
    )
    return out


def _tags(keyword_map) -> str:
    parts = [
        f"CASE WHEN regexp_matches(ctext, {q(words(ws))}) THEN {q(tag)} END"
        for tag, ws in keyword_map.items()
    ]
    return f"list_filter([{', '.join(parts)}], lambda v: v IS NOT NULL)"


def _in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


_CTEXT = collapse(fold("concat_ws(' ', title, company, location, description)"))
_RTEXT = "lower(concat_ws(' ', title, description))"


def classified_ctes(source: str, tag: str = "") -> list[tuple[str, str]]:
    t = fx.TAXONOMY
    alias = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in t.aliases.items())
    tracks = " ".join(
        f"WHEN {q(r)} THEN [{', '.join(q(c) for c in cs)}]"
        for r, cs in t.role_concentrations.items()
        if cs
    )
    roles = f"list_concat(list_filter(role_tags, lambda v: v IN {_in(t.roles)}), {_tags(t.role_keywords)})"
    given = (
        f"list_filter(list_transform(concentration_tags, lambda v: CASE WHEN v IN {_in(t.concentrations)}"
        f" THEN v ELSE CASE v {alias} END END), lambda v: v IS NOT NULL)"
    )
    from_roles = (
        f"flatten(list_transform(new_roles, lambda r: coalesce(CASE r {tracks} END, []::VARCHAR[])))"
    )
    label = "coalesce(nullif(seniority, ''), CASE "
    for name, ws in fx.SENIORITY:
        label += f"WHEN regexp_matches(rtext, {q(words(ws))}) THEN {q(name)} "
    label += "ELSE 'Early/Mid' END)"
    return [
        (f"ct1{tag}", f"SELECT *, {_CTEXT} AS ctext, {_RTEXT} AS rtext FROM {source}"),
        (f"ct2{tag}", f"SELECT *, {roles} AS roles_all FROM ct1{tag}"),
        (f"ct3{tag}", f"SELECT *, {first_seen('roles_all')} AS new_roles FROM ct2{tag}"),
        (
            f"ct4{tag}",
            f"""SELECT *, list_concat(list_concat({given}, {from_roles}), {_tags(t.concentration_keywords)}) AS conc_all
                FROM ct3{tag}""",
        ),
        (
            f"classified{tag}",
            f"""SELECT ordinal, source, source_job_id, title, company, location, description, url,
                  posted_date, employment_type, seniority, opt_cpt_flag, created_at, updated_at, rtext,
                  new_roles AS role_tags, {first_seen('conc_all')} AS concentration_tags,
                  {label} AS seniority_label
                FROM ct4{tag}""",
        ),
    ]


def base_ctes() -> list[tuple[str, str]]:
    return [("postings_raw", _sql(fx.POSTINGS)), ("normalized", NORMALIZED), ("valid", VALID)]


def unique_ctes() -> list[tuple[str, str]]:
    return [
        *base_ctes(),
        ("keyed", KEYED),
        *dedup_ctes(),
        ("uniq", "SELECT * FROM valid WHERE ordinal IN (SELECT ordinal FROM kept)"),
        *classified_ctes("uniq"),
    ]


# --- profiles and ranking ---------------------------------------------------

_TERMS = lambda c: f"list_filter(list_transform({text_list(c)}, lambda v: lower({strip('v')})), lambda v: v <> '')"
PROFILES = f"""
SELECT profile_no, coalesce({or_null('student_id')}, left({stable_hash('name')}, 10)) AS student_key, name,
  concentration, coalesce(academic_stage, stage) AS academic_stage, coalesce(stage, academic_stage) AS stage,
  coalesce(work_auth_status = 'Need CPT / OPT sponsorship', FALSE) AS needs_opt,
  CASE WHEN regexp_matches({fold("coalesce(nullif(academic_stage, ''), stage, '')")}, 'incoming|internship|fall') THEN 'Entry'
       WHEN regexp_matches({fold("coalesce(nullif(academic_stage, ''), stage, '')")}, 'returning|finishing|graduate') THEN 'Early/Mid' END AS preferred_seniority,
  {_TERMS('skills_text')} AS skill_terms, {_TERMS('target_roles_text')} AS role_terms,
  {text_list('target_roles_text')} AS target_roles, ai_matching_consent, profile_version
FROM profiles_raw"""


def profile_ctes(statement: str = fx.PROFILES) -> list[tuple[str, str]]:
    return [
        ("profiles_raw", _sql(statement)),
        ("people_all", PROFILES),
        ("people", "SELECT * FROM people_all WHERE ai_matching_consent"),
    ]


# every term the profile statement can produce; constant patterns compile once
FIXTURE_TERMS = (
    "software engineer", "hast", "data analyst / bi engineer", "cybersecurity analyst",
    "of the", "ing", "ai", "tion", "ersh", "enou", "c++", "que",
)


def boundary(t: str) -> str:
    left = f"(^|{_NW})" if re.match(r"\w", t) else _W
    right = f"($|{_NW})" if re.search(r"\w$", t) else _W
    return left + re.sub(r"([^\w\s])", r"\\\1", t) + right


def hit_ctes(source: str, tag: str = "", terms=FIXTURE_TERMS, w=RankingWeights()) -> list[tuple[str, str]]:
    return [
        (
            f"pterms{tag}",
            """SELECT profile_no, 1 AS kind, unnest(skill_terms) AS term, generate_subscripts(skill_terms, 1) AS pos FROM people
               UNION ALL
               SELECT profile_no, 2 AS kind, unnest(role_terms) AS term, generate_subscripts(role_terms, 1) AS pos FROM people""",
        ),
        (f"vocab{tag}", f"SELECT DISTINCT term FROM pterms{tag}"),
        (
            f"thits{tag}",
            "SELECT * FROM ("
            + " UNION ALL ".join(
                f"SELECT {q(t)} AS term, ordinal FROM {source} WHERE regexp_matches(rtext, {q(boundary(t))})"
                for t in terms
            )
            + f") WHERE term IN (SELECT term FROM vocab{tag})",
        ),
        (
            f"khits{tag}",
            f"""SELECT 1 AS kind, term, ordinal FROM thits{tag}
                UNION ALL
                SELECT DISTINCT 2 AS kind, term, ordinal FROM (
                  SELECT term, ordinal FROM thits{tag}
                  UNION ALL SELECT {fold('r')}, ordinal FROM (SELECT unnest(role_tags) AS r, ordinal FROM {source}))""",
        ),
        (
            f"sparse{tag}",
            f"""SELECT t.profile_no, h.ordinal,
                  sum(CASE t.kind WHEN 1 THEN {w.skill} ELSE {w.role} END)::DOUBLE AS s,
                  string_agg(CASE t.kind WHEN 1 THEN 'Skill match: ' ELSE 'Target role match: ' END || t.term,
                             '; ' ORDER BY t.kind, t.pos) AS r
                FROM pterms{tag} t JOIN khits{tag} h ON h.kind = t.kind AND h.term = t.term
                GROUP BY 1, 2""",
        ),
    ]


def rank_ctes(
    source: str = "classified", tag: str = "", people: str = "people", terms=FIXTURE_TERMS, w=RankingWeights()
) -> list[tuple[str, str]]:
    """Every profile against every posting, scored and fully sorted."""
    return [
        *hit_ctes(source, tag, terms, w),
        (
            f"scored{tag}",
            f"""SELECT s.profile_no, s.student_key, s.name, s.profile_version, s.target_roles, p.ordinal,
                  p.title, p.company, p.location, p.source, p.url, p.posted_date, p.role_tags,
                  p.concentration_tags, p.opt_cpt_flag, p.seniority_label,
                  coalesce(h.s, 0.0)
                  + CASE WHEN list_contains(p.concentration_tags, s.concentration) THEN {w.concentration} ELSE 0.0 END
                  + CASE WHEN s.needs_opt AND p.opt_cpt_flag THEN {w.opt_cpt} ELSE 0.0 END
                  + CASE WHEN s.preferred_seniority = p.seniority_label THEN {w.seniority}
                         WHEN s.preferred_seniority IS NOT NULL THEN {w.seniority_mismatch} ELSE 0.0 END AS score,
                  concat_ws('; ', h.r,
                    CASE WHEN list_contains(p.concentration_tags, s.concentration) THEN 'Concentration match: ' || s.concentration END,
                    CASE WHEN s.needs_opt AND p.opt_cpt_flag THEN 'CPT/OPT-friendly signal' END,
                    CASE WHEN s.preferred_seniority = p.seniority_label THEN 'Seniority match: ' || p.seniority_label
                         WHEN s.preferred_seniority IS NOT NULL THEN 'Seniority mismatch: ' || p.seniority_label END) AS reasons
                FROM {people} s CROSS JOIN {source} p
                LEFT JOIN sparse{tag} h ON h.profile_no = s.profile_no AND h.ordinal = p.ordinal""",
        ),
        (
            f"ranked{tag}",
            f"""SELECT *, row_number() OVER (PARTITION BY profile_no ORDER BY score DESC,
                  posted_date DESC NULLS LAST, company DESC, title DESC, ordinal) AS rank_position
                FROM scored{tag}""",
        ),
    ]


def full_rank() -> list[tuple[str, str]]:
    return [*unique_ctes(), *profile_ctes(), *rank_ctes()]


# --- aliased export ---------------------------------------------------------


def aliased_ctes() -> list[tuple[str, str]]:
    return [
        ("raw_aliased", _sql(fx.RAW_ALIASED)),
        (
            "fields",
            f"""SELECT ordinal, coalesce({or_null('job_id')}, {or_null('req_id')}) AS source_job_id,
                  coalesce({or_null('title')}, {or_null('job_title')}) AS title, {or_null('employer')} AS company,
                  coalesce({or_null('city')}, 'Not specified') AS location, {or_null('summary')} AS description,
                  {or_null('job_url')} AS apply_url, {strip('date_posted')} AS day, concentration_tags, {fold(strip('opt_cpt_flag'))} AS flag
                FROM raw_aliased""",
        ),
        (
            "checked",
            """SELECT *, array_to_string(list_filter([CASE WHEN title IS NULL THEN 'title' END,
                 CASE WHEN company IS NULL THEN 'company' END, CASE WHEN description IS NULL THEN 'description' END,
                 CASE WHEN apply_url IS NULL THEN 'apply_url' END], lambda v: v IS NOT NULL), ', ') AS missing,
                 regexp_matches(coalesce(apply_url, ''), '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#\\s]+([/?#]|$)') AS good_url
               FROM fields""",
        ),
        (
            "aliased",
            f"""SELECT ordinal,
                  coalesce(source_job_id, 'ksbit-' || left({stable_hash("concat_ws('|', company, title, location, apply_url)")}, 16)) AS source_job_id,
                  source_job_id IS NULL AS generated, title, company, location, description,
                  regexp_replace(apply_url, '^HTTPS://Example.com', 'https://example.com') AS url,
                  CASE WHEN regexp_matches(day, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(left(day, 10) AS DATE) END AS posted_date,
                  {text_list('concentration_tags')} AS concentration_tags,
                  CASE WHEN flag IN ('true','yes','y','1') THEN TRUE WHEN flag IN ('false','no','n','0') THEN FALSE END AS opt_cpt_flag
                FROM checked WHERE missing = '' AND good_url""",
        ),
    ]


SINCE = "posted_date IS NULL OR posted_date >= DATE '2026-06-02'"

# --- history ----------------------------------------------------------------

RUN1 = "posted_date < DATE '2026-04-20'"


def identity_ctes(source: str, name: str) -> list[tuple[str, str]]:
    """Identities of the rows of ``source`` with their priority."""
    return [
        (
            name,
            f"""SELECT ordinal, 1 AS priority, 'source_job_id' AS identity_type,
                  {fold(strip('source'))} || ':' || {fold(strip('source_job_id'))} AS identity_value
                FROM {source} WHERE {or_null('source_job_id')} IS NOT NULL AND {strip('source')} <> ''
                UNION ALL SELECT ordinal, 2, 'canonical_url', {canonical('url')} FROM {source} WHERE url <> ''
                UNION ALL SELECT ordinal, 3, 'content_signature',
                  {stable_hash("concat_ws('||', " + fold(strip('title')) + ", " + fold(strip('company')) + ", " + fold(strip('location')) + ", " + fold(collapse('description')) + ")")}
                FROM {source}""",
        )
    ]


def key_of(prefix: str, t: str = "") -> str:
    return f"sha256(lower('{prefix}:' || {t}identity_type || ':' || {t}identity_value))"


def normalized_key_ctes(source: str, name: str) -> list[tuple[str, str]]:
    return [
        *identity_ctes(source, f"{name}_ids"),
        (
            name,
            f"""SELECT ordinal, min_by({key_of('normalized')}, priority) AS normalized_key,
                  min_by({key_of('job')}, priority) AS own_key
                FROM {name}_ids GROUP BY ordinal""",
        ),
    ]


def history_ctes(ranked: bool = False) -> list[tuple[str, str]]:
    """Two runs: the earlier postings first, then all of them."""
    out = [*base_ctes(), ("keyed", KEYED)]
    if ranked:
        out += profile_ctes()
    for run, cond in (("1", RUN1), ("2", "TRUE")):
        out += [
            (f"norm{run}", f"SELECT * FROM normalized WHERE {cond}"),
            (f"keyed{run}", f"SELECT * FROM keyed WHERE ordinal IN (SELECT ordinal FROM norm{run})"),
            *dedup_ctes(f"keyed{run}", f"r{run}x"),
            (
                f"uniq{run}",
                f"SELECT * FROM valid WHERE ordinal IN (SELECT ordinal FROM keptr{run}x)",
            ),
            *normalized_key_ctes(f"norm{run}", f"nk{run}"),
            *normalized_key_ctes(f"uniq{run}", f"jk{run}"),
        ]
        if ranked:
            out += [
                *classified_ctes(f"uniq{run}", f"_{run}"),
                *rank_ctes(f"classified_{run}", f"_{run}"),
            ]
    out += [
        ("res1", "SELECT ordinal, own_key AS job_key, TRUE AS is_new FROM jk1"),
        (
            "stored1",
            """SELECT i.identity_type, i.identity_value, r.job_key
               FROM jk1_ids i JOIN res1 r ON r.ordinal = i.ordinal""",
        ),
        (
            "res2",
            """SELECT j.ordinal, coalesce(h.k, j.own_key) AS job_key, h.k IS NULL AS is_new
               FROM jk2 j LEFT JOIN (SELECT i.ordinal, min_by(s.job_key, i.priority) AS k
                 FROM jk2_ids i JOIN stored1 s ON s.identity_type = i.identity_type AND s.identity_value = i.identity_value
                 GROUP BY i.ordinal) h ON h.ordinal = j.ordinal""",
        ),
        (
            "jobs_log",
            "SELECT 1 AS run, ordinal, job_key FROM res1 UNION ALL SELECT 2, ordinal, job_key FROM res2",
        ),
        (
            "ids_log",
            """SELECT 1 AS run, i.ordinal, i.identity_type, i.identity_value, r.job_key
               FROM jk1_ids i JOIN res1 r ON r.ordinal = i.ordinal
               UNION ALL SELECT 2, i.ordinal, i.identity_type, i.identity_value, r.job_key
               FROM jk2_ids i JOIN res2 r ON r.ordinal = i.ordinal""",
        ),
        (
            "ids_state",
            """SELECT identity_type, identity_value, arg_max(job_key, run * 1000000000000 + ordinal) AS job_key,
                 count(*) AS n, min(run) AS first_run, max(run) AS last_run
               FROM ids_log GROUP BY 1, 2""",
        ),
        (
            "jobs_state",
            "SELECT job_key, count(*) AS n, min(run) AS first_run, max(run) AS last_run FROM jobs_log GROUP BY 1",
        ),
        (
            "norm_state",
            """SELECT normalized_key, count(*) AS seen_count, min(run) AS first_run, max(run) AS last_run FROM (
                 SELECT 1 AS run, normalized_key FROM nk1 UNION ALL SELECT 2, normalized_key FROM nk2) GROUP BY 1""",
        ),
    ]
    if ranked:
        out.append(
            (
                "match_log",
                """SELECT 1 AS run, m.profile_no, m.student_key, m.profile_version, r.job_key, m.score, m.rank_position
                   FROM ranked_1 m JOIN res1 r ON r.ordinal = m.ordinal WHERE m.rank_position <= 5
                   UNION ALL
                   SELECT 2, m.profile_no, m.student_key, m.profile_version, r.job_key, m.score, m.rank_position
                   FROM ranked_2 m JOIN res2 r ON r.ordinal = m.ordinal WHERE m.rank_position <= 5""",
            )
        )
    return out


def _profile_errors() -> str:
    from jobweave.vocab import PROFILE_ENUMS as E

    def missing(c):
        return f"CASE WHEN {c} IS NULL THEN 'Missing required field: {c}' END"

    def enum(c, blank=False):
        extra = "" if blank else f" AND {c} <> ''"
        return f"CASE WHEN {c} NOT IN {_in(E[c])}{extra} THEN 'Invalid {c}: \"' || {c} || '\"' END"

    def members(c, label):
        v = text_list(f"{c}_text")
        return (
            f"CASE WHEN len({v}) = 0 THEN ['{c} must be a non-empty array'] ELSE list_transform("
            f"list_filter({v}, lambda v: v NOT IN {_in(E[c])}), lambda v: 'Invalid {label}: \"' || v || '\"') END"
        )

    heads = [
        missing(c)
        for c in ("concentration", "academic_stage", "work_auth_status", "delivery_preference",
                  "profile_version", "updated_at", "ai_matching_consent")
    ] + [
        enum(c)
        for c in ("concentration", "academic_stage", "work_auth_status", "delivery_preference",
                  "match_frequency")
    ] + [enum("remote_preference", True)]
    sponsored = "work_auth_status = 'Need CPT / OPT sponsorship'"
    tails = [
        f"CASE WHEN {sponsored} AND coalesce(opt_eligibility_date, '') = '' THEN "
        "'opt_eligibility_date is required when work_auth_status is ''Need CPT / OPT sponsorship''' END",
        f"CASE WHEN {sponsored} AND opt_eligibility_date <> '' AND NOT regexp_matches(opt_eligibility_date, "
        "'^\\d{4}-\\d{2}-\\d{2}$') THEN 'opt_eligibility_date must be in YYYY-MM-DD format' END",
        "CASE WHEN coalesce(profile_version < 1, TRUE) THEN 'profile_version must be an integer >= 1' END",
        "CASE WHEN try_cast(updated_at AS TIMESTAMPTZ) IS NULL THEN 'updated_at must be a valid ISO-8601 date-time string' END",
        "CASE WHEN ai_matching_consent IS NULL THEN 'ai_matching_consent must be a boolean' END",
    ]
    skills = (
        "list_filter(list_transform(string_split(skills_text, ';'), lambda s, i: CASE WHEN "
        f"{strip('s')} = '' THEN 'skills[' || CAST(i - 1 AS VARCHAR) || '] must be a non-empty string' END), lambda v: v IS NOT NULL)"
    )
    keep = lambda xs: f"list_filter([{', '.join(xs)}], lambda v: v IS NOT NULL)"
    joined = (
        f"list_concat(list_concat(list_concat(list_concat({keep(heads)}, {members('target_roles', 'target_role')}),"
        f" {members('geo_preference', 'geo_preference')}), {skills}), {keep(tails)})"
    )
    return with_(
        [("raw", _sql(fx.CONTRACT_PROFILES)), ("e", f"SELECT profile_no, {joined} AS errors FROM raw")],
        "SELECT profile_no, len(errors)::BIGINT AS error_count, array_to_string(errors, ' | ') AS errors FROM e",
    )


_EXPORT = """SELECT profile_no, rank_position, student_key AS student_id, name AS student_name, title, company,
  location, source, url AS "apply_url/post_url", array_to_string(role_tags, '; ') AS role_category,
  array_to_string(target_roles, '; ') AS target_role, array_to_string(concentration_tags, '; ') AS concentration_tags,
  seniority_label AS seniority_level, opt_cpt_flag, round(score, 4) AS final_score,
  CASE WHEN reasons = '' THEN 'No deterministic match signals found' ELSE reasons END AS ranking_explanation
FROM ranked WHERE rank_position <= 5"""


def oracle_sql() -> dict[str, str]:
    t = fx.TAXONOMY
    out: dict[str, str] = {}
    out["q_normalize"] = with_(
        base_ctes(),
        f"""SELECT ordinal, title, company, location, sha256(description) AS description_sha,
              sha256({collapse(fold('description'))}) AS folded_sha, employment_type, seniority FROM normalized""",
    )
    out["q_url_census"] = with_(
        [("u", f"SELECT page_id, {canonical('url')} AS canonical_url, {url_parts(strip('url'))['host']} AS host FROM pages")],
        """SELECT canonical_url, host, count(*) AS pages, min(page_id) AS first_page FROM u GROUP BY 1, 2""",
    )
    out["q_content_keys"] = with_(
        [*base_ctes(), ("keyed", KEYED)],
        "SELECT key_content, count(*) AS group_size, min(ordinal) AS first_ordinal FROM keyed GROUP BY 1",
    )
    stats = " UNION ALL ".join(
        f"""SELECT {q(kind)} AS kind, {q(tag)} AS tag, {q(w)} AS keyword, count(*) AS postings
            FROM ct WHERE regexp_matches(ctext, {q(words([w]))})"""
        for kind, m in (("role", t.role_keywords), ("concentration", t.concentration_keywords))
        for tag, ws in m.items()
        for w in ws
    )
    out["q_keyword_stats"] = with_(
        [*base_ctes(), ("ct", f"SELECT {_CTEXT} AS ctext FROM valid")],
        f"SELECT * FROM ({stats}) WHERE postings > 0",
    )
    out["q_term_stats"] = with_(
        [*base_ctes(), ("ct", f"SELECT ordinal, {_RTEXT} AS rtext, role_tags FROM valid"), *profile_ctes(), *hit_ctes("ct")],
        """SELECT h.term, h.postings, p.profiles FROM (SELECT term, count(*) AS postings FROM thits GROUP BY 1) h
           JOIN (SELECT term, count(DISTINCT profile_no) AS profiles FROM pterms GROUP BY 1) p ON p.term = h.term""",
    )
    out["q_ingest_aliased"] = with_(
        aliased_ctes(),
        """SELECT ordinal, source_job_id, generated, title, company, location, sha256(description) AS description_sha,
             url, posted_date, array_to_string(concentration_tags, ';') AS concentration_tags, opt_cpt_flag FROM aliased""",
    )
    out["q_since_date"] = with_(
        aliased_ctes(),
        f"SELECT ordinal, source_job_id, posted_date, posted_date IS NULL AS undated FROM aliased WHERE {SINCE}",
    )
    out["q_source_limit"] = with_(
        aliased_ctes(),
        f"SELECT ordinal, source_job_id FROM aliased WHERE {SINCE} ORDER BY ordinal LIMIT 25",
    )
    out["q_union_sources"] = with_(
        [*base_ctes(), *aliased_ctes()],
        f"""SELECT ordinal, source, {strip('title')} AS title, company FROM postings_raw
            UNION ALL SELECT ordinal + {1 << 58}, 'ksbit_export', title, company FROM aliased""",
    )
    reg = ", ".join(f"({q(r[0])}, {q(r[1])})" for r in fx.REGISTRY)
    out["q_approved_sources"] = with_(
        [*base_ctes(), ("registry", f"SELECT * FROM (VALUES {reg}) v(name, status)")],
        """SELECT p.source, coalesce(r.status, 'unregistered') AS status, coalesce(r.status = 'approved', FALSE) AS allowed,
             count(*) AS postings, count(*) FILTER (r.status = 'approved') AS loaded
           FROM postings_raw p LEFT JOIN registry r ON r.name = p.source GROUP BY 1, 2, 3""",
    )
    contract = " ".join(
        f"WHEN {strip(c)} = '' THEN '{c}: String should have at least 1 character'"
        for c in ("source", "title", "company", "location", "description", "url")
    )
    out["q_rejects"] = with_(
        [*base_ctes(), *aliased_ctes(),
         ("c", f"SELECT ordinal, CASE {contract} END AS reason FROM postings_raw")],
        """SELECT 'contract' AS stage, ordinal, reason FROM c WHERE reason IS NOT NULL
           UNION ALL SELECT 'required', ordinal, 'missing required field(s): ' || missing FROM checked WHERE missing <> ''
           UNION ALL SELECT 'contract', ordinal, 'url: Input should be a valid URL' FROM checked WHERE missing = '' AND NOT good_url""",
    )
    out["q_validate_counts"] = with_(
        [*base_ctes(), *aliased_ctes()],
        f"""SELECT (SELECT count(*) FROM raw_aliased) AS raw_count, (SELECT count(*) FROM aliased) AS loaded_count,
             (SELECT count(*) FROM raw_aliased) - (SELECT count(*) FROM aliased) AS skipped_count,
             (SELECT count(*) FROM aliased WHERE {SINCE}) AS returned_count,
             (SELECT count(*) FROM normalized) AS normalized_count, (SELECT count(*) FROM valid) AS valid_count""",
    )
    dd = [*base_ctes(), ("keyed", KEYED), *dedup_ctes()]
    out["q_dedup"] = with_(
        dd,
        f"""SELECT v.ordinal, v.title, (SELECT count(*) FROM u{ROUNDS}) AS undecided
            FROM valid v WHERE v.ordinal IN (SELECT ordinal FROM kept)""",
    )
    out["q_duplicates"] = with_(
        [*dd, ("long", """SELECT ordinal, 0 AS p, 'url' AS matched_on, key_url AS k FROM keyed
            UNION ALL SELECT ordinal, 1, 'source_id', key_source_id FROM keyed WHERE key_source_id IS NOT NULL
            UNION ALL SELECT ordinal, 2, 'content', key_content FROM keyed""")],
        """SELECT d.ordinal, arg_min(o.ordinal, d.p) AS kept_ordinal, arg_min(d.matched_on, d.p) AS matched_on
           FROM long d JOIN long o ON o.p = d.p AND o.k = d.k AND o.ordinal < d.ordinal
           WHERE d.ordinal NOT IN (SELECT ordinal FROM kept) AND o.ordinal IN (SELECT ordinal FROM kept)
           GROUP BY d.ordinal""",
    )
    # row after row, as the rule is told
    out["q_dedup_chain"] = f"""
WITH RECURSIVE chains AS ({_sql(fx.CHAINS)}),
k AS (SELECT row_number() OVER (ORDER BY ordinal) AS i, *,
  list_filter(['u' || key_url, 's' || key_source_id, 'c' || key_content], lambda v: v IS NOT NULL) AS ks FROM chains),
walk AS (SELECT 0::BIGINT AS i, ['']::VARCHAR[] AS seen, false AS kept
  UNION ALL SELECT k.i, CASE WHEN list_has_any(w.seen, k.ks) THEN w.seen ELSE list_concat(w.seen, k.ks) END,
    NOT list_has_any(w.seen, k.ks) FROM walk w JOIN k ON k.i = w.i + 1),
f AS (SELECT k.*, walk.kept FROM k JOIN walk USING (i)),
why AS (SELECT d.ordinal, min(CASE WHEN o.key_url = d.key_url THEN 0 WHEN o.key_source_id = d.key_source_id THEN 1 ELSE 2 END) AS p,
    arg_min(o.ordinal, CASE WHEN o.key_url = d.key_url THEN 0 WHEN o.key_source_id = d.key_source_id THEN 1 ELSE 2 END) AS kept_ordinal
  FROM f d JOIN f o ON o.kept AND NOT d.kept AND o.ordinal < d.ordinal AND list_has_any(o.ks, d.ks) GROUP BY 1)
SELECT f.ordinal, f.kept, kept_ordinal, ['url', 'source_id', 'content'][p + 1] AS matched_on
FROM f LEFT JOIN why USING (ordinal)"""
    cl = [*base_ctes(), *classified_ctes("valid")]
    out["q_classify"] = with_(
        cl,
        """SELECT ordinal, array_to_string(role_tags, ';') AS role_tags,
             array_to_string(concentration_tags, ';') AS concentration_tags FROM classified""",
    )
    out["q_seniority"] = with_(cl, "SELECT ordinal, seniority_label FROM classified")
    out["q_profile_features"] = with_(
        profile_ctes(),
        """SELECT profile_no, student_key, academic_stage, stage, needs_opt, preferred_seniority,
             array_to_string(skill_terms, ';') AS skill_terms, array_to_string(role_terms, ';') AS role_terms
           FROM people_all""",
    )
    out["q_profile_errors"] = _profile_errors()
    cols = "profile_no, student_key, ordinal, score, reasons, seniority_label, rank_position"
    out["q_rank"] = with_(full_rank(), f"SELECT {cols} FROM ranked WHERE rank_position <= 25")
    out["q_topk"] = with_(
        full_rank(), "SELECT profile_no, rank_position, ordinal, score FROM ranked WHERE rank_position <= 5"
    )
    out["q_topk_authorized"] = with_(
        [*full_rank(),
         ("allowed", """SELECT profile_no, ordinal, score, reasons,
             row_number() OVER (PARTITION BY profile_no ORDER BY rank_position) AS rank_position
             FROM ranked WHERE coalesce(opt_cpt_flag, TRUE)
               OR profile_no NOT IN (SELECT profile_no FROM people WHERE needs_opt)""")],
        "SELECT profile_no, rank_position, ordinal, score, reasons FROM allowed WHERE rank_position <= 5",
    )
    wide = {
        "q_topk_wide": RankingWeights(skill=1.5, role=2.0, concentration=4.0, opt_cpt=0.5),
        "q_topk_negative": RankingWeights(skill=-1.0, role=3.0, concentration=-2.0),
    }
    for name, w in wide.items():
        out[name] = with_(
            [*unique_ctes(), *profile_ctes(fx.WIDE_PROFILES),
             *rank_ctes(terms=tuple(dict.fromkeys((*FIXTURE_TERMS, *fx.WIDE_WORDS))), w=w)],
            "SELECT profile_no, rank_position, ordinal, score, reasons FROM ranked WHERE rank_position <= 3",
        )
    out["q_export_rows"] = with_(full_rank(), _EXPORT)
    out["q_export_order"] = with_(
        full_rank(),
        """SELECT profile_no, ordinal, row_number() OVER (ORDER BY student_key, score DESC, company, title,
             profile_no, rank_position) AS export_position FROM ranked WHERE rank_position <= 5""",
    )
    out["q_student_matches"] = with_(
        full_rank(),
        """SELECT student_key, ordinal, score, reasons, rank_position FROM ranked WHERE student_key = 'S1'""",
    )
    out["q_digest"] = with_(
        [*full_rank(),
         ("lines", """SELECT profile_no, string_agg(concat(CAST(rank_position AS VARCHAR), '. ', title, ' at ', company, chr(10),
              '   Location: ', location, chr(10), '   Score: ', printf('%.1f', score), chr(10), '   URL: ', url, chr(10)),
              chr(10) ORDER BY rank_position) AS body FROM ranked WHERE rank_position <= 3 GROUP BY 1""")],
        """SELECT s.profile_no, s.student_key, concat('Hello ', s.name, ',', chr(10), chr(10), 'Here are your current job matches:',
             chr(10), chr(10), coalesce(l.body, 'No matches are available yet.'), chr(10), chr(10),
             'This digest was generated automatically.') AS digest
           FROM people s LEFT JOIN lines l ON l.profile_no = s.profile_no""",
    )
    uq = unique_ctes()
    opt = "CASE WHEN opt_cpt_flag THEN 'cpt_opt_friendly' WHEN NOT opt_cpt_flag THEN 'not_cpt_opt_friendly' ELSE 'unknown' END"
    week = "coalesce(strftime(date_trunc('week', posted_date), '%Y-%m-%d'), 'unknown')"
    dims = {
        "total_jobs": "'all'", "sources": "source", "companies": "company", "locations": "location",
        "seniority": "coalesce(seniority, 'Unknown')", "opt_cpt_signals": opt, "posting_weeks": week,
        "roles": "unnest(role_tags)", "concentrations": "unnest(concentration_tags)",
    }
    out["q_trend_counts"] = with_(
        uq,
        "SELECT dimension, value, count(*) AS n FROM ("
        + " UNION ALL ".join(f"SELECT {q(d)} AS dimension, {e} AS value FROM classified" for d, e in dims.items())
        + ") GROUP BY 1, 2",
    )
    out["q_trend_rollup"] = with_(
        [*uq, ("tags", """SELECT company, unnest(role_tags) AS role_category, unnest(concentration_tags) AS concentration_track,
             location, source, seniority, employment_type, opt_cpt_flag AS opt_cpt_signal,
             CAST(date_trunc('week', posted_date) AS DATE) AS posting_week, created_at, updated_at FROM classified
             WHERE posted_date >= DATE '2026-06-15' - 90""")],
        """SELECT company, role_category, concentration_track, location, source, seniority, employment_type, opt_cpt_signal,
             posting_week, count(*) AS posting_count, min(created_at) AS first_seen_date, max(updated_at) AS last_seen_date
           FROM tags GROUP BY ALL""",
    )
    out["q_skill_trend"] = with_(
        [*uq, *profile_ctes(), *hit_ctes("classified")],
        f"""SELECT {week} AS posting_week, h.term AS skill_keyword, count(*) AS posting_count
            FROM thits h JOIN classified c ON c.ordinal = h.ordinal GROUP BY 1, 2""",
    )
    out["q_run_summary"] = with_(
        full_rank(),
        """SELECT (SELECT count(*) FROM normalized) AS normalized_count, (SELECT count(*) FROM valid) AS valid_count,
             (SELECT count(*) FROM normalized) - (SELECT count(*) FROM valid) AS invalid_count,
             (SELECT count(*) FROM valid) - (SELECT count(*) FROM kept) AS duplicate_count,
             (SELECT count(*) FROM kept) AS unique_count, (SELECT count(*) FROM classified) AS classified_count,
             (SELECT count(*) FROM people_all) AS profile_count, (SELECT count(*) FROM people) AS active_profile_count,
             (SELECT count(*) FROM ranked WHERE rank_position <= 5) AS total_ranked_matches""",
    )
    out["q_eval_accuracy"] = with_(
        cl,
        """SELECT count(*) AS record_count,
             coalesce(avg(CASE WHEN l.quality = 0 OR list_contains(c.role_tags, 'Data Analyst / BI Engineer') THEN 1.0 ELSE 0.0 END), 0.0) AS role_accuracy,
             coalesce(avg(CASE WHEN l.toxic = 0 OR list_contains(c.concentration_tags, 'Cybersecurity') THEN 1.0 ELSE 0.0 END), 0.0) AS concentration_accuracy
           FROM classified c JOIN labels l ON l.doc_id = c.ordinal""",
    )
    # evaluation ranks the postings before they are tagged
    untagged = f"""SELECT *, {_RTEXT} AS rtext, coalesce(nullif(seniority, ''), CASE """ + " ".join(
        f"WHEN regexp_matches({_RTEXT}, {q(words(ws))}) THEN {q(n)}" for n, ws in fx.SENIORITY
    ) + " ELSE 'Early/Mid' END) AS seniority_label FROM (SELECT * REPLACE ([]::VARCHAR[] AS role_tags, []::VARCHAR[] AS concentration_tags) FROM valid WHERE ordinal IN (SELECT doc_id FROM labels))"
    out["q_eval_rel3"] = with_(
        [*base_ctes(), ("plain", untagged), *profile_ctes(), *rank_ctes("plain")],
        """SELECT count(*) AS profile_count, avg(CASE WHEN f.profile_no IS NOT NULL THEN 1.0 ELSE 0.0 END) AS ranking_relevance
           FROM people s LEFT JOIN (SELECT DISTINCT profile_no FROM ranked
             WHERE rank_position <= 3 AND ordinal % 50 = profile_no % 50) f ON f.profile_no = s.profile_no""",
    )
    hist = history_ctes()
    hist_ranked = history_ctes(ranked=True)
    out["q_identities"] = with_(
        [*base_ctes(), *identity_ctes("valid", "ids")],
        f"""SELECT ordinal, priority::BIGINT AS priority, identity_type, identity_value,
              {key_of('normalized')} AS normalized_key, {key_of('job')} AS job_key FROM ids""",
    )
    out["q_validation_status"] = with_(
        [*base_ctes(), *normalized_key_ctes("normalized", "nk")],
        """SELECT normalized_key, CASE WHEN bool_or(ordinal IN (SELECT ordinal FROM valid)) THEN 'valid' ELSE 'invalid' END AS validation_status
           FROM nk GROUP BY 1""",
    )
    out["q_identity_resolve"] = with_(hist, "SELECT ordinal, job_key, is_new FROM res2")
    out["q_seen_counts"] = with_(
        hist,
        "SELECT normalized_key, seen_count, 'run-' || last_run AS last_run_id FROM norm_state",
    )
    out["q_merge"] = with_(
        hist,
        """SELECT 'job_identities' AS table_name, identity_type || ':' || identity_value AS entity, job_key, n AS times,
             'run-' || last_run AS last_run_id FROM ids_state
           UNION ALL SELECT 'deduped_jobs', job_key, job_key, n, 'run-' || last_run FROM jobs_state
           UNION ALL SELECT 'classification_results', job_key, job_key, n, 'run-' || last_run FROM jobs_state""",
    )
    out["q_stream_ingest"] = with_(
        hist,
        """SELECT l.job_key, arg_max(v.title, l.run * 1000000000000 + l.ordinal) AS title,
             arg_max(v.company, l.run * 1000000000000 + l.ordinal) AS company, count(*) AS seen_count
           FROM jobs_log l JOIN valid v ON v.ordinal = l.ordinal GROUP BY l.job_key""",
    )
    out["q_match_history"] = with_(
        hist_ranked,
        """SELECT sha256(lower(concat_ws(':', 'match', student_key, CAST(profile_version AS VARCHAR), job_key, 'deterministic-v0'))) AS match_key,
             student_key, job_key, arg_max(score, run * 1000 + rank_position) AS latest_score, count(*) AS times_matched,
             'run-' || min(run) AS first_run_id, 'run-' || max(run) AS last_run_id
           FROM match_log GROUP BY student_key, profile_version, job_key""",
    )
    out["q_table_counts"] = with_(
        hist_ranked,
        """SELECT 'pipeline_runs' AS table_name, 2::BIGINT AS row_count
           UNION ALL SELECT 'normalized_jobs', count(*) FROM norm_state
           UNION ALL SELECT 'deduped_jobs', count(*) FROM jobs_state
           UNION ALL SELECT 'job_identities', count(*) FROM ids_state
           UNION ALL SELECT 'classification_results', count(*) FROM jobs_state
           UNION ALL SELECT 'ranking_scores', count(*) FROM (SELECT DISTINCT student_key, profile_version, job_key FROM match_log)
           UNION ALL SELECT 'match_history', count(*) FROM (SELECT DISTINCT student_key, profile_version, job_key FROM match_log)""",
    )
    return out
