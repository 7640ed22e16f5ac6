"""Names, vocabularies and limits of the project ledger."""

from __future__ import annotations

# Results must use these words, names, cut-offs and limits as they are.
INFRASTRUCTURE_WORDS = (
    "road", "bridge", "building", "street light", "streetlight", "water system", "drainage", "concreting", "multi purpose", "school", "construction",
    "rehabilitation", "rehab", "pathway", "footwalk", "fence", "flood control", "pavement", "canal", "extension of", "improvement of", "repair of",
    "day care center", "day care", "gym", "court light", "solar street light", "solarized street light",
)
NON_INFRASTRUCTURE_WORDS = (
    "purchase", "computer", "training", "seminar", "equipment", "supplies", "medical mission", "feeding", "livelihood", "sound system", "assistance",
    "capacity building", "workshop", "relief", "scholarship", "uniform", "socio cultural", "cultural activities", "monoblock", "chairs", "tables",
    "laptop", "printer", "projector", "cctv", "camera", "grass cutter", "radio", "trapal", "honorarium", "procurement of", "fiesta", "covid", "prizes",
)
EXTENSION_WORDS = ("typhoon", "bagyo", "flood", "landslide", "calamity", "force majeure", "el niño", "el nino", "la niña", "la nina", "weather", "storm")
COMPLETED_WORDS = ("complet",)
REFUND_WORDS = ("refund",)
NOT_IMPLEMENTED_WORDS = ("not implement", "not yet implement", "not-implement", "unimplemented")
BIDDING_WORDS = ("bid", "procure", "philgeps", "canvass", "ntp", "notice to proceed")
MISSING_WORDS = ("NA", "N/A", "NONE", "NULL", "-", "")
STANDARD_DAYS = {"Infrastructure": 365, "Non-Infrastructure": 182}
STATUS_VOCABULARY = {
    "completed": "Completed",
    "completed/ fuctional": "Completed/Functional",
    "completed/ functional": "Completed/Functional",
    "completed/ fuctional.": "Completed/Functional",
    "completed/functional": "Completed/Functional",
    "completed/ function": "Completed/Functional",
    "completed/ funtional": "Completed/Functional",
    "completed/funtional": "Completed/Functional",
    "on-going": "On-going",
    "on going": "On-going",
    "ongoing": "On-going",
    "not implemented": "Not Implemented",
    "not yet implemented": "Not Implemented",
    "for bidding": "For Bidding",
    "for implementation": "For Implementation",
}
LABEL_PREFIXES = {"STATUS_clean_": "Status", "municipality_canonical_": "Municipality", "project_type_": "Project Type", "contractor_spec_": "Contractor Specialization"}
LABELS = {
    "AMOUNT (Php)": "Budget (₱, scaled)",
    "Year": "Release Year",
    "days_since_release": "Time Since Release (scaled)",
    "release_month": "Release Month",
    "release_quarter": "Release Quarter",
    "is_wet_season_release": "Wet-Season Release (Jun-Nov)",
    "amount_outlier_flag": "Unusually Large/Small Budget Flag",
    "historical_delay_rate": "Contractor Historical Delay Rate",
    "reliability_score": "Contractor Reliability Score",
}
TIER_EDGES = ((0.3, "Low"), (0.7, "Medium"), (0.9, "High"))
TIER_TOP = "Critical"
TIERS = ("Low", "Medium", "High", "Critical")
WEEK_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DATE_FORMATS = ("MM/dd/yyyy", "M/d/yyyy", "M-d-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd", "M/d/yy")
DAY_FIRST_FORMAT = "d/M/yyyy"
SERIAL_RANGE = (10_000, 60_000)
SERIAL_ORIGIN = "1899-12-30"
DATE_WINDOW = ("2000-01-01", "2030-12-31")
WET_MONTHS = (6, 7, 8, 9, 10, 11)
FUZZY_CUTOFF = 82
FUZZY_TOP = 5
YEAR_TOLERANCE = 2
OUTLIER_LEAST_ROWS = 10
SEQUENCE_STEPS = 5
CONFIDENCE = 0.7
VISITS_PER_DAY = 3
DAYS_PER_INSPECTOR = 4
TIER_REWARD = {"Critical": 2.5}
CLUSTER_PENALTY = 0.75
PRIORITY_LEAST = 10
PRIORITY_FALLBACK = 60
