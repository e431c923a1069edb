"""Declared schemas of the stored tables (nothing is inferred)."""

ATTACHMENTS = "array<struct<kind:string,name:string,url:string>>"

LISTED = "source string, source_notice_id string, url string, title string, listed_date string, pinned boolean, pos int"

NOTICE = (
    "id bigint, source string, source_notice_id string, source_url string, title string, original_content string, "
    "raw_html string, published_at date, board_category string, author string, "
    f"attachments {ATTACHMENTS}, content_hash string, crawled_at timestamp, content_updated_at timestamp, "
    "dedup_key string, dup_of bigint"
)

EVIDENCE = "struct<applicationStart:string,applicationEnd:string,deadline:string,eventDate:string>"
EN = "struct<title:string,summary:array<string>,easyExplanation:string,target:string,eventInfo:string>"

# The reply of the record analyser, as JSON.
ANALYSIS_JSON = (
    "category string, applicationStart string, applicationEnd string, deadline string, eventDate string, "
    "target string, summary array<string>, easyExplanation string, "
    f"evidence {EVIDENCE}, uncertain array<struct<field:string,reason:string>>, en {EN}"
)

BOARD = (
    "source string, alias string, ord int, kind string, college string, major string, url_prefix string, "
    "default_limit int"
)

PROFILE = (
    "profile_id string, college string, major string, year int, entrance_year int, interests array<string>"
)

PROFILE_FILE = "id string, profile struct<college:string,major:string,year:string,entranceYear:string,interests:array<string>>"

IMPORTED_EVENT = "uid string, title string, date string, all_day boolean"
