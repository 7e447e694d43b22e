"""The tables that the operators work on."""

from __future__ import annotations

#: Public account snapshots of a platform.
PROFILE = (
    "platform string, username string, user_id string, display_name string, description string, profile_image_url string, profile_url string, "
    "category string, stream_title string, tags array<string>, language string, is_live boolean, extra_links array<string>, extra_bio string, "
    "broadcaster_type string, created_at string, source string"
)
#: Rows of a sheet; original_row is the only identity of a row.
SHEET_ROW = "original_row int, source_value string, country string, existing_destination string, existing_remarks string"
#: Cells of a sheet.
CELL = "sheet string, row int, col int, value string"
#: Picture features of an address: 64-bit hashes of each variant.
IMAGE = "url string, sha256 string, low_complexity boolean, variants map<string,struct<p:bigint,d:bigint,a:bigint>>"
#: Human verdicts: CONFIRMED or REJECTED.
VERDICT = "source_key string, target_key string, verdict string, updated_at timestamp"
