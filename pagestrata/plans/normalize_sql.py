"""The normalizer as SQL over a table of pages, an independent wording of its rules for checking results."""

from __future__ import annotations

from pagestrata.operators import normalize as N

# Unicode white space, as the inside of a character class.
WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pattern(java: str) -> str:
    """A pattern with white space written as this dialect writes it."""
    return _text(java.replace(N.SPACE, WS))


def _among(names: list[str]) -> str:
    return "(" + ", ".join(map(_text, names)) + ")"


def _attribute(attrs: str, *names: str) -> str:
    return "coalesce(" + ", ".join(f"""nullif({_trim(f"regexp_extract({attrs}, '{n}=\"([^\"]+)\"', 1)")}, '')""" for n in names) + ")"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _table(pairs: dict[str, str], of: str) -> str:
    return "CASE " + of + " " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in pairs.items()) + " END"


NORMAL_SQL = rf"""
nz_text AS (
  SELECT body_id, markdown, {_trim("replace(markdown, chr(13) || chr(10), chr(10))")} || chr(10) AS original FROM page_bodies),
nz_rows AS (
  SELECT *, CASE WHEN original IS NULL OR original = chr(10) THEN [''] ELSE string_split(regexp_replace(original, '\r?\n\z', ''), chr(10)) END AS ls FROM nz_text),
nz_first AS (
  SELECT *, coalesce(list_position(list_transform(ls, lambda x: {_trim('x')} <> ''), true), 0) AS first FROM nz_rows),
nz_rest AS (SELECT *, ls[greatest(first, 1):] AS rest FROM nz_first),
nz_stop AS (
  SELECT *, coalesce(list_position(list_transform(rest, lambda x: NOT (starts_with(ltrim(regexp_replace(x, '^[{WS}]+', '')), '>') OR {_trim('x')} = '')), true), 0) AS stop,
    len(ls) >= 3 AND first > 0 AND starts_with({_trim('rest[1]')}, '> ## Documentation Index') AND len(list_filter(rest[1:5], lambda x: contains(x, 'llms.txt'))) > 0 AS indexed FROM nz_rest),
nz_kept AS (
  SELECT body_id, original, markdown IS NULL AS none, CASE WHEN indexed THEN CASE WHEN stop = 0 THEN len(rest) ELSE stop - 1 END ELSE 0 END AS removed, ls, rest, first, indexed FROM nz_stop),
nz_cut AS (
  SELECT body_id, original, none, removed, CASE WHEN indexed THEN list_concat(ls[1:greatest(first - 1, 0)], rest[removed + 1:]) ELSE ls END AS kept FROM nz_kept),
nz_line AS (
  SELECT body_id, unnest(CASE WHEN len(kept) = 0 THEN [''] ELSE kept END) AS raw, unnest(range(greatest(len(kept), 1))) AS pos FROM nz_cut),
nz_a AS (
  SELECT body_id, pos, replace(raw, chr(9), '    ') AS line FROM nz_line),
nz_b AS (
  SELECT *, length(line) - length(ltrim(line, ' ')) AS lead, regexp_replace(line, {_text(N.TOOLTIP)}, '\1', 'g') AS line2, {_trim('line')} AS bare_line FROM nz_a),
nz_c AS (SELECT *, {_trim('line2')} AS t FROM nz_b),
nz_d AS (
  SELECT *, CASE
    WHEN t = '' THEN 'blank'
    WHEN NOT regexp_matches(t, '^[<{{=!?`ie]') THEN CASE WHEN contains(t, '<img ') THEN 'asset' ELSE 'line' END
    WHEN regexp_matches(t, {_pattern(N.MODULE)}) OR regexp_matches(t, {_pattern(N.COMMENT)}) THEN 'module'
    WHEN contains(t, '<img ') THEN 'asset'
    WHEN regexp_matches(t, {_pattern(N.GITBOOK)}) THEN 'gitbook'
    WHEN regexp_matches(t, {_pattern(N.MKDOCS_TAB)}) THEN 'tab'
    WHEN regexp_matches(t, {_pattern(N.MKDOCS_NOTE)}) THEN 'note'
    WHEN regexp_matches(t, {_pattern(N.OPEN_TAG)}) THEN 'open'
    WHEN regexp_matches(t, {_pattern(N.SUMMARY)}) THEN 'summary'
    WHEN t IN {_among(list(N.CALLOUT_TAGS))} THEN 'callout'
    WHEN t IN {_among(N.WRAPPERS)} THEN 'wrapper'
    WHEN starts_with(t, '<Badge ') OR starts_with(t, '<VPBadge ') THEN 'badge'
    WHEN starts_with(t, '<') AND ends_with(t, '>') AND regexp_matches(regexp_replace(t, '^(?:</)*<*', ''), '^[A-Z]') THEN 'component'
    WHEN regexp_matches(t, {_pattern(N.FENCE)}) THEN 'fence' ELSE 'line' END AS r FROM nz_c),
nz_e AS (
  SELECT *, CASE r WHEN 'gitbook' THEN regexp_extract(t, {_pattern(N.GITBOOK)}, 1) WHEN 'open' THEN regexp_extract(t, {_pattern(N.OPEN_TAG)}, 1) END AS tag,
    CASE r WHEN 'gitbook' THEN regexp_extract(t, {_pattern(N.GITBOOK)}, 2) WHEN 'open' THEN regexp_extract(t, {_pattern(N.OPEN_TAG)}, 2) END AS attrs,
    CASE r WHEN 'tab' THEN {_trim(f"regexp_extract(t, {_pattern(N.MKDOCS_TAB)}, 1)")} WHEN 'summary' THEN {_trim(f"regexp_extract(t, {_pattern(N.SUMMARY)}, 1)")}
      WHEN 'fence' THEN regexp_extract(t, {_pattern(N.FENCE)}, 1) END AS word,
    CASE WHEN r = 'line' THEN regexp_replace(line2, {_pattern(N.COMPONENT)}, '', 'g') END AS bare FROM nz_d),
nz_f AS (
  SELECT *, CASE WHEN r = 'note' THEN CASE WHEN regexp_matches(t, '["''].+["''][{WS}]*\z') THEN {_trim(f"regexp_extract(t, {_pattern(N.MKDOCS_NOTE)}, 2)")} END
      WHEN r = 'open' THEN {_attribute('attrs', 'title', 'label', 'value', 'summary', 'text')} WHEN tag = 'hint' THEN {_attribute('attrs', 'title')}
      WHEN tag = 'tab' THEN coalesce({_attribute('attrs', 'title', 'label')}, 'Tab') END AS title,
    lower(coalesce(trim(CASE WHEN r = 'note' THEN regexp_extract(t, {_pattern(N.MKDOCS_NOTE)}, 1) WHEN tag = 'hint' THEN {_attribute('attrs', 'type', 'style')} WHEN tag = 'Callout' THEN {_attribute('attrs', 'type')} END, '"'), 'note')) AS kind,
    CASE WHEN tag IN ('Card', 'VPCard') THEN {_attribute('attrs', 'href')} END AS href, CASE WHEN tag IN ('Card', 'VPCard') THEN {_attribute('attrs', 'desc')} END AS descr,
    regexp_replace(bare, '[{WS}]+$', '') AS final FROM nz_e),
nz_g AS (SELECT *, {_table(N.CALLOUTS, 'kind')} AS known FROM nz_f),
nz_h AS (
  SELECT *, CASE WHEN known IS NULL THEN coalesce(title, array_to_string(list_transform(list_filter(regexp_split_to_array(kind, '[-_ ]'), lambda p: p <> ''), lambda p: upper(p[1]) || p[2:]), ' ')) || ':'
    WHEN coalesce(title, '') <> '' THEN known || ': ' || title ELSE known || ':' END AS callout FROM nz_g),
nz_i AS (
  SELECT *, CASE
      WHEN r = 'blank' THEN [''] WHEN tag IN ('hint', 'Callout') OR r = 'note' THEN [callout]
      WHEN tag = 'tab' AND r = 'gitbook' THEN ['### ' || title] WHEN r = 'tab' THEN ['### ' || word]
      WHEN r = 'open' THEN list_filter([CASE WHEN tag IN ('Tab', 'TabItem') THEN '### ' ELSE '## ' END || title, 'Source: ' || href, descr], lambda x: x IS NOT NULL)
      WHEN r = 'summary' THEN ['## ' || word] WHEN r = 'callout' THEN [{_table(N.CALLOUT_TAGS, 't')}] WHEN r = 'fence' THEN ['```' || word]
      WHEN r = 'line' AND final <> '' THEN [final] ELSE [] END AS emit,
    r = 'line' AND final <> '' AS plain,
    CASE WHEN r IN ('blank', 'asset') THEN 0 WHEN r = 'fence' THEN CAST(t <> '```' || word AS INT) WHEN r = 'line' THEN CAST(bare <> line2 AS INT) + CAST(final = '' AS INT) ELSE 1 END AS wrappers,
    CASE WHEN r IN ('module', 'component') THEN 'mdx' WHEN r = 'gitbook' THEN 'gitbook' WHEN r IN ('tab', 'note') THEN 'mkdocs' WHEN r = 'badge' THEN 'vitepress' WHEN r = 'summary' THEN 'docusaurus'
      WHEN r = 'callout' THEN 'mintlify' WHEN r = 'wrapper' THEN CASE WHEN contains(t, 'details') THEN 'docusaurus' ELSE 'mintlify' END
      WHEN r = 'open' THEN CASE WHEN tag = 'TabItem' THEN 'docusaurus' WHEN tag IN ('Callout', 'Details') THEN 'nextra' WHEN tag = 'VPCard' THEN 'vitepress' ELSE 'mintlify' END END AS profile,
    coalesce(CASE WHEN r = 'gitbook' THEN tag IN ('hint', 'tab', 'tabs') WHEN r IN ('tab', 'note', 'open', 'summary', 'callout') THEN true WHEN r = 'wrapper' THEN false END,
      CASE WHEN lead < 4 AND NOT (bare_line IN {_among(N.CLOSING)} OR starts_with(bare_line, '{{% end')) AND bare_line <> '' THEN false END) AS event FROM nz_h),
nz_j AS (
  SELECT body_id, pos, unnest(CASE WHEN len(emit) = 0 THEN [NULL] ELSE emit END) AS shown0, unnest(range(greatest(len(emit), 1))) AS sub, plain, lead, event, wrappers, profile, line2 <> line AS tip, r = 'asset' AS asset FROM nz_i),
nz_k AS (SELECT * REPLACE (CASE WHEN sub = 0 THEN event END AS event), {_trim('shown0')} AS shown FROM nz_j),
nz_l AS (
  SELECT *, coalesce(last_value(event IGNORE NULLS) OVER w, false) AS dedent, last_value(nullif(shown, '') IGNORE NULLS) OVER w AS before FROM nz_k
  WINDOW w AS (PARTITION BY body_id ORDER BY pos, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
nz_m AS (
  SELECT *, CASE WHEN plain AND dedent AND lead >= 4 AND starts_with(shown0, '    ') THEN substr(shown0, 5) ELSE shown0 END AS final, coalesce(starts_with(shown, '#') AND shown = before, false) AS again FROM nz_l),
nz_n AS (
  SELECT body_id, sum(CASE WHEN sub = 0 THEN wrappers + CAST(tip AS INT) ELSE 0 END) AS wrappers, sum(CASE WHEN sub = 0 AND asset THEN 1 ELSE 0 END) AS assets, sum(CAST(again AS INT)) AS repeats,
    count(final) FILTER (NOT again) AS n, chr(1) || chr(10) || coalesce(string_agg(final, chr(10) ORDER BY pos, sub) FILTER (final IS NOT NULL AND NOT again), '') || chr(10) || chr(1) AS fenced FROM nz_m GROUP BY 1),
nz_p AS (
  SELECT body_id, array_to_string(list(profile ORDER BY place), ',') AS profiles FROM (
    SELECT body_id, profile, min(place) AS place FROM (
      SELECT body_id, 'mintlify' AS profile, 2 * pos AS place FROM nz_k WHERE tip AND sub = 0 UNION ALL SELECT body_id, profile, 2 * pos + 1 FROM nz_k WHERE profile IS NOT NULL AND sub = 0)
    GROUP BY ALL) GROUP BY 1),
nz_q AS (SELECT *, regexp_replace(fenced, '\n{{3,}}', chr(10) || chr(10), 'g') AS closed FROM nz_n),
normal AS (
  SELECT body_id, CASE WHEN none THEN NULL WHEN n = 0 THEN '' ELSE {_trim('closed[3:-3]')} || chr(10) END AS markdown, original, none, coalesce(profiles, '') AS profiles, removed, wrappers, assets, repeats,
    CASE WHEN n = 0 THEN 0 ELSE length(fenced) - length(closed) END AS blanks
  FROM nz_cut JOIN nz_q USING (body_id) LEFT JOIN nz_p USING (body_id))
"""

NORMALIZED_SQL = f"""WITH {NORMAL_SQL}
SELECT body_id, sha256(markdown) AS markdown, CASE WHEN NOT none THEN markdown <> original END AS changed, profiles AS profiles_applied,
  CAST(CASE WHEN none THEN 0 ELSE CAST(removed > 0 AS INT) END AS BIGINT) AS boilerplate_blocks_removed, CAST(CASE WHEN none THEN 0 ELSE wrappers + removed END AS BIGINT) AS component_wrappers_removed,
  CAST(CASE WHEN none THEN 0 ELSE repeats END AS BIGINT) AS duplicate_headings_removed, CAST(CASE WHEN none THEN 0 ELSE assets END AS BIGINT) AS asset_lines_removed,
  CAST(CASE WHEN none THEN 0 ELSE blanks END AS BIGINT) AS blank_lines_collapsed FROM normal
"""
