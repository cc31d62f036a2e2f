"""Schemas of the evidence tables, the graph and the manifest."""

from __future__ import annotations

from .operators.postings import BLOCKS, FREQUENCIES, LENGTHS

DOCUMENTS = "doc_id string, s3key string, asset_team string, format_gate string, page_count int"
PAGES = (
    "page_id string, doc_id string, s3key string, asset_team string, text string, page_num int, width int, height int, "
    "vector array<float>, clip_vector array<float>, has_screenshot boolean"
)
#: Screenshots are apart from pages, so that page scans stay narrow.
SCREENSHOTS = "page_id string, doc_id string, screenshot binary"
CHUNKS = "chunk_id string, page_id string, doc_id string, s3key string, asset_team string, text string, page_num int, n_terms int, vector array<float>"
ASSETS = "asset_id string, page_id string, doc_id string, s3key string, asset_team string, kind string, page_num int, image binary, clip_vector array<float>"
LEDGER = "doc_id string, s3key string, checksum string, status string, reason string, page_count int, chunk_count int, asset_count int, updated_at string"
EVIDENCE = {"documents": DOCUMENTS, "pages": PAGES, "screenshots": SCREENSHOTS, "chunks": CHUNKS, "assets": ASSETS, "postings": BLOCKS, "lengths": LENGTHS, "frequencies": FREQUENCIES, "ledger": LEDGER}

NODES = "id string, type string, name string, properties string"
EDGES = "source string, target string, label string, properties string"
MANIFEST = "key string, asset_team string, well string, category string, entry_type string, well_name_meta string, bytes string, parse_source string, parsed_ref string"
NOMINATIONS = "key string, doc_id string, well string, category string, format_gate string, page_count string"
WELLS = "EID string, API_10 string, WELL_NAME string, LEASE_NAME string, COMPANY_NAME string, OPERATOR_NAME string, STATE string, COUNTY string"
VENDORS = "VENDOR_ID string, VENDOR_NAME string, VENDOR_FULL_NAME string"
ALIASES = "alias string, class string, master_name string"

TEXT_DIMS, CLIP_DIMS = 1536, 512
#: Columns that every hit carries; never binary ones.
HIT = ("page_id", "doc_id", "s3key", "asset_team", "page_num")
