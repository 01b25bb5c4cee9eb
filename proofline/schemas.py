"""Schemas and closed vocabularies of the record tables."""

from __future__ import annotations

# Closed vocabularies.
EXTRACTOR_STATES = ["TRANSCRIBED", "MANUAL_REVIEW_REQUIRED", "UNREADABLE"]
PAGE_STATES = ["SOURCE_INPUT_INVALID", "RA_COLUMN_UNRESOLVED"]
GATE_STATES = ["STRUCTURALLY_ADMISSIBLE", "MANUAL_REVIEW_REQUIRED", "UNREADABLE"]
VERDICTS = ["PAIRED", "PAIRING_UNRESOLVED", "UNPAIRED_DEC_ONLY", "UNPAIRED_RA_ONLY", "PAGE_MISSING_ON_OTHER_SIDE"]
INDEX_AGREEMENT = ["AGREE", "DIFFER"]
BYTE_INTEGRITY = ["CONSISTENT_WITH_SOURCE_PUBLISHED_CHECKSUM", "MISMATCH_OR_ABSENT"]
SOURCE_AUTHENTICITY = "UNESTABLISHED"
FAILURES = ["DOWNLOAD", "SOURCE_INPUT_INVALID", "INTEGRITY", "EXTRACTION"]
MISSINGNESS = ["PRESENT_LEGIBLE", "PRESENT_ILLEGIBLE", "ABSENT_FROM_ARCHIVE", "NOT_DIGITISED", "UNDETERMINED"]
PAGE_CLASSES = ["HEADER_PAGE", "DATA_PAGE", "JOB_LISTING_PAGE", "UNDETERMINED"]
CONSTANCY = ["CONSTANCY_SAMPLE_PASS", "CONSTANCY_SAMPLE_FAIL", "CONSTANCY_SAMPLE_FAIL_AND_UNREADABLE", "CONSTANCY_SAMPLE_UNREADABLE_OR_AMBIGUOUS"]
ELIGIBILITY = ["D2_SPATIAL_ELIGIBLE", "D2_SPATIAL_INELIGIBLE", "ROW_LEVEL_REQUIRED", "UNRESOLVED"]
VALUE_BASIS = ["SEALED_DERIVATION", "ARCHIVE_INSTRUMENT_STRUCTURE", "CONTROLLER_CHOICE"]
OUTCOMES = ["NOVEL_CANDIDATE_FOUND", "NO_NOVEL_RESULT_FOUND", "INSUFFICIENT_DATA"]

_COMMON = """run string, folder string, page string, row_index int, row_y array<int>, source_url string, transport string,
source_published_sha1 string, source_published_sha1_semantics string, local_sha1 string, local_sha256 string,
byte_integrity string, source_authenticity string, extractor string, extractor_sha256 string, gate_sha256 string,
raw_reads array<string>, normalised array<string>, extractor_state string, extractor_value string,
gate_version string, gate_state string, gate_reason string"""

#: One row for each band of a page, declination side.
DEC_ROWS = _COMMON
#: The same for right ascension; page-level records have a page_state and no row_y.
RA_ROWS = _COMMON + ", page_state string, ra_column array<int>"
FAILURE_ROWS = "run string, folder string, page string, source_url string, transport string, ok boolean, failure string, detail string, published_sha1 string, local_sha1 string"
MANIFEST = "name string, sha1 string"
RUNS = "run string, folder string, first int, last int"

#: What a joined record carries of each side.
SIDE_FIELDS = ["row_index", "extractor", "extractor_sha256", "gate_sha256", "extractor_state", "extractor_value", "gate_state", "gate_reason", "local_sha256", "byte_integrity", "source_authenticity"]
RA_FIELDS = [*SIDE_FIELDS, "ra_column"]
