"""Schemas of the engine's logical tables, and its closed sets of values."""

# Fixed values.
PREDICATES = ("DERIVES_FROM", "GOVERNS", "IMPLEMENTS", "EVIDENCES", "TRANSMUTES")
EXPOSURES = ("public", "restricted", "private")  # from least to most restrictive
CHARTER_PLACEHOLDER = "Charter it in debrief before minting notes."
FRONTIER_PROVENANCE = "frontier-model"
FRONTIER_FIELDS = ("frontier_model", "frontier_request", "source_intake", "source_coverage", "uncertainty")
ID_PATTERN = r"^[a-z0-9-]+:[a-z0-9-]+$"

EDGE = "struct<predicate:string,target:string,rationale:string>"
NODES = (
    "id string, parent string, related array<" + EDGE + ">, title string, description string, type string, domain string, "
    "exposure string, status string, created date, updated date, tags array<string>, path string, body string, source_links array<string>, malformed boolean"
)
EDGES = "src string, predicate string, dst string, rationale string"
DOMAINS = "name string, exposure string, vault_name string"
CHARTERS = "domain string, body string, families array<string>, principles array<string>, updated date"
CAPTURES = "capture string, batch string, domain string, bytes bigint, sha256 string, detected_type string"
INVENTORY = (
    "relative_path string, bytes bigint, sha256 string, detected_type string, selected_sensor string, declined_route string, "
    "tier2_outputs array<string>, archive_path string"
)
INTAKES = "intake_id string, kind string, request string, source_hashes array<string>, declined_route string, inventory_path string, domain string"
FRONTIER = (
    "artifact_id string, kind string, provenance string, frontier_model string, frontier_request string, source_intake string, "
    "source_coverage string, uncertainty string, source_sha256 string, source_inventory string, related array<" + EDGE + ">"
)
DEBRIEFS = "record_id string, domain string, state string, primary_asset string"
ROUTES = "detected_type string, platform string, tool string, priority int"
VIOLATION = "rule string, subject string, detail string"
