"""The schemas of the tables that are read and written."""

from __future__ import annotations

NORMALIZATION = (
    "struct<applied:boolean,normalizer:string,profiles_applied:array<string>,changed:boolean,boilerplate_blocks_removed:bigint,"
    "component_wrappers_removed:bigint,duplicate_headings_removed:bigint,asset_lines_removed:bigint,blank_lines_collapsed:bigint>"
)
QUALITY = (
    "struct<score:int,rating:string,word_count:bigint,non_empty_lines:bigint,text_lines:bigint,heading_count:bigint,code_block_count:bigint,link_count:bigint,"
    "residual_html_tags:bigint,residual_mdx_components:bigint,title_present:boolean,text_density:float,low_signal_reasons:array<string>>"
)
CHUNK = "struct<chunk_id:string,page_key:string,ordinal:bigint,heading:string,section_path:array<string>,chunk_path:string,sha256:string,byte_size:bigint,word_count:bigint>"
PAGE = (
    "struct<page_key:string,url:string,final_url:string,fetch_method:string,status:string,change_status:string,reused_from_snapshot:string,page_path:string,metadata_path:string,"
    "raw_path:string,rendered_raw_path:string,content_type:string,sha256:string,raw_sha256:string,etag:string,last_modified:string,byte_size:bigint,"
    f"normalization:{NORMALIZATION},quality:{QUALITY},chunks:array<{CHUNK}>>"
)
DIFF = "struct<previous_snapshot_label:string,new_pages:bigint,changed_pages:bigint,unchanged_pages:bigint,removed_pages:bigint,import_candidates:bigint>"
#: A manifest as it is stored in JSON; fields that a file lacks are null.
MANIFEST = (
    "schema_version int, created_at string, source_name string, entry_url string, source_kind string, version_strategy string, source_ref string, snapshot_label string, snapshot_dir string, "
    f"status string, detected_input_kind string, suggested_mode string, diff {DIFF}, notes array<string>, pages array<{PAGE}>"
)
#: The current version of a manifest and the version that a config is brought to.
MANIFEST_VERSION, CONFIG_VERSION = 7, 2

# The enumerations.
SOURCE_KINDS = ["auto", "git_docs", "website", "mixed"]
VERSION_STRATEGIES = ["auto", "git_ref", "docs_prefix", "date_snapshot"]
CHANGE_STATUSES = ["unknown", "new", "changed", "unchanged", "removed"]
RATINGS = ["high", "medium", "low"]
