"""Fixed values.

Word lists, patterns, codes and label names that are part of the data contract:
results are only right when they hold exactly these values, so they are stated
here as plain text, together, and nowhere else.
"""

# Survey placeholders that count as "no answer" (compared in lower case).
PLACEHOLDERS = ("question not applicable", "hidden answer", "none")

# Placeholders that mark an amount or band as unusable.
AMOUNT_PLACEHOLDERS = ("hidden answer", "question not applicable")

# Cell texts read as null.
NULL_TOKENS = ("NA", " ", "Question not applicable")

# Order in which properties appear in a structured column name.
COLUMN_PROPERTIES = ("column", "sheet", "number", "translated", "model", "label", "value")

# Classifier models and their labels.
MODEL_LABELS = {
    "climate_specificity": ("spec", "non"),
    "environmental_claims": ("yes", "no"),
    "transition": ("LABEL_0", "LABEL_1", "LABEL_2"),
    "climate_commitment": ("yes", "no"),
    "tcfd": ("strategy", "governance", "risk", "metrics", "none"),
    "climate_sentiment": ("opportunity", "neutral", "risk"),
    "netzero_reduction": ("net-zero", "reduction", "none"),
    "renewable": ("LABEL_0", "LABEL_1"),
}

# The 20 label counts of the indicator table, in output order.
KPI_LABELS = (
    ("environmental_claims", "yes"),
    ("environmental_claims", "no"),
    ("climate_commitment", "yes"),
    ("climate_commitment", "no"),
    ("climate_specificity", "spec"),
    ("climate_specificity", "non"),
    ("netzero_reduction", "reduction"),
    ("netzero_reduction", "net-zero"),
    ("climate_sentiment", "opportunity"),
    ("climate_sentiment", "risk"),
    ("climate_sentiment", "neutral"),
    ("tcfd", "strategy"),
    ("tcfd", "risk"),
    ("tcfd", "metrics"),
    ("tcfd", "governance"),
    ("transition", "LABEL_0"),
    ("transition", "LABEL_1"),
    ("transition", "LABEL_2"),
    ("renewable", "LABEL_0"),
    ("renewable", "LABEL_1"),
)

# Means that carry their own name instead of <model>_label_<label>_mean.
KPI_MEAN_NAMES = {
    ("climate_specificity", "spec"): "percent_specificity",
    ("climate_specificity", "non"): "percent_non_specificity",
}

# Currency spellings -> ISO code.
CURRENCY_ALIASES = {
    "XXX": "USD",
    "USN": "USD",
    "EUR(€)": "EUR",
    "GBP(£)": "GBP",
    "JPY(¥)": "JPY",
    "CAD ($)": "CAD",
    "AUD ($)": "AUD",
    "NZD ($)": "NZD",
    "CNY(¥)": "CNY",
    "INR(Rp)": "INR",
    "SGD ($)": "SGD",
    "ARS($)": "ARS",
    "BRL(R$)": "BRL",
    "MXN ($)": "MXN",
    "ZAR (R)": "ZAR",
    "USD($)": "USD",
    "CHW": "CHF",
}

# Payback bands.
LONG_PAYBACK = (
    "4-10 years", "4 - 10 years", "11-15 years", "21-25 years", ">25 years", "16-20 years",
)
PAYBACK_ORDER = ("<1 year", "1-3 years", ">3 years", "No payback")
QUARTILE_LABELS = ("Q1 (Smallest)", "Q2", "Q3", "Q4 (Largest)")

# Company-name cleaning: ordered (pattern, replacement), after upper-casing.
NAME_RULES = (
    (r"[.,\-/]", ""),
    (r", INC.|, INC| INC.| INC$", " INCORPORATED"),
    (r", LTD.|, LTD| LTD$", " LTD"),
    (r", LLC", " LLC"),
    (r" PLC$", " PLC"),
    (r", S.A.| S/A", " SA"),
    (r"\s*\([^\)]+\)", ""),
    (r"INT'L", "INTL"),
    (r" CO.,| CO,| CO ", " COMPANY"),
    (r"\.", ""),
    (r",", ""),
    (r"LIMITED", "LTD"),
    (r"CORPORATION", "CORP"),
    (r"-", ""),
    (r"  ", " "),
    (r"\+", " PLUS "),
    (r"COMPANYLTD|COLTD", "COMPANY LTD"),
)
# The same list with the company form matched as a whole word only.
NAME_RULES_WHOLE_WORD = (
    (r"[.,\-/]", ""),
    (r"\bINC\b", "INCORPORATED"),
    (r"\s*\([^\)]+\)", ""),
    (r"INT'L", "INTL"),
    (r"\bCO\b", "COMPANY"),
    (r"\bLIMITED\b", "LTD"),
    (r"\bCORPORATION\b", "CORP"),
    (r"\+", " PLUS "),
    (r"COMPANYLTD|COLTD", "COMPANY LTD"),
    (r" +", " "),
)

# Industry categories: first hit wins, case ignored.
INDUSTRY_RULES = (
    ("software|technology|semiconductors|telecommunication|professional services", "Technology and Telecommunications"),
    ("pharmaceuticals|biotechnology|health|life sciences", "Healthcare and Life Sciences"),
    ("energy|utilities|oil|gas|fossil|waste management|power", "Energy and Utilities"),
    ("banks|insurance|financial|estate", "Financial Services"),
    ("retail|consumer|household|apparel|personal|food|beverage|agriculture|home|distributors", "Consumer Goods and Retail"),
    ("transportation|logistics|air|water|ground|railroad|truck|tires", "Transportation and Logistics"),
    ("construction|manufacturing|industrial|aerospace|automobiles|equipment|machinery|building products|infrastructure", "Industrials and Manufacturing"),
    ("mining|materials|chemicals|forest|packaging|extract|mineral", "Materials and Extraction"),
    ("hospitality|leisure|tourism|media|tobacco", "Consumer Services and Leisure"),
    ("public|education|ngo|international", "Public Services and NGOs"),
)

# Regions: country names.
NORTH_AMERICA = ("USA", "Canada", "Bermuda", "Mexico", "United States of America", "United States Minor Outlying Islands")
SOUTH_AMERICA = ("Brazil", "Argentina", "Chile", "Peru", "Colombia", "Uruguay", "Venezuela", "Paraguay")
CARIBBEAN = ("Trinidad", "Panama", "El Salvador", "Costa Rica", "Guatemala", "Honduras", "Bahamas", "Jamaica", "Dominican Republic", "Belize", "British Virgin Islands", "Cayman Islands", "Guyana", "Trinidad and Tobago")
OCEANIA = ("Australia", "New Zealand", "Fiji", "Tuvalu")
ASIA = ("Viet Nam", "India", "South Korea", "Korea", "Republic of Korea", "Japan", "China", "Taiwan", "Thailand", "Singapore", "Hong Kong", "Philippines", "United Arab Emirates", "Pakistan", "Bangladesh", "Indonesia", "Vietnam", "Malaysia", "Kazakhstan", "Mongolia", "Sri Lanka", "Jordan", "Oman", "Cambodia", "Qatar", "Greater China")
EUROPE = ("Czechia", "Albania", "Liechtenstein", "Guernsey", "Cyprus", "Russia", "Russian Federation", "Italy", "Switzerland", "Spain", "United Kingdom", "Ireland", "France", "Germany", "Netherlands", "Finland", "Sweden", "Austria", "Belgium", "Denmark", "Norway", "Portugal", "Poland", "Hungary", "Czech Republic", "Slovakia", "Greece", "Romania", "Bulgaria", "Croatia", "Luxembourg", "Slovenia", "Iceland", "Malta", "Monaco", "Lithuania", "Belarus", "Ukraine")
AFRICA = ("Ecuador", "South Africa", "Tunisia", "Nigeria", "Kenya", "Zimbabwe", "Egypt", "Mozambique", "Tanzania", "Swaziland", "Ghana", "Cameroon", "Equatorial Guinea", "Mauritius")
MIDDLE_EAST = ("Israel", "Turkey", "Saudi Arabia", "Kuwait", "Oman", "United Arab Emirates", "Qatar", "Jordan")

# Region lookup order, exact names (no Caribbean) and partial names.
REGIONS_EXACT = (
    ("Europe", EUROPE), ("North America", NORTH_AMERICA), ("South America", SOUTH_AMERICA),
    ("Asia", ASIA), ("Oceania", OCEANIA), ("Africa", AFRICA), ("Middle East", MIDDLE_EAST),
)
REGIONS_PARTIAL = (
    ("Europe", EUROPE), ("North America", NORTH_AMERICA), ("South America", SOUTH_AMERICA),
    ("Caribbean", CARIBBEAN), ("Oceania", OCEANIA), ("Asia", ASIA), ("Africa", AFRICA),
    ("Middle East", MIDDLE_EAST),
)

# Initiative-type flags: pattern per flag, case ignored.
INITIATIVE_FLAGS = (
    ("process_efficiency", "energy efficiency: Processes|Process emissions reductions|Waste recovery|fugitive emissions reductions|combined heat and power|cogeneration|product design|process optimization|process material substitution|electrification|retire*fossil fuel*generation|fuel switch|fuel efficiency|energy efficient*generator|machine equipment replacement"),
    ("low_carbon_installation", "Low carbon energy installation|low-carbon energy installation|solar|wind"),
    ("building_energy_efficiency", "Energy efficiency: Building services|Building Energy Management Systems|\\(BEMS\\)|Heating, Ventilation and Air Conditioning \\(HVAC\\)|hvac|Energy efficiency: Building fabric|building fabric|Lighting|leed*certificat|insulation|bms"),
    ("low_carbon_purchase", "Low carbon energy purchase|low-carbon energy purchase|purchas* renewable|electricity mix|renewable*certificate|purchas*zero carbon|renewable*power source|green energy procurement|offset"),
    ("behavioral_change", "Behavioral change|Teleworking|Employee commuting"),
    ("transportation", "Transportation: fleet|Transportation: use|Company fleet vehicle replacement|electric bicycle|electric*charging station|less emitting vehicles|less emmiting vehicles|fleet vehicle efficiency"),
    ("other", "Other, please specify|Other"),
)
INITIATIVE_NOT_ANSWERED = "NA, NA|Question not applicable"

# Ordinal codes of target answers: (code, pattern), first hit wins, null codes 0.
SCIENCE_BASED_INTENSITY_CODES = (
    (0, "Question not applicable|Hidden Answer|Don't know|No.*do not anticipate.*next 2 years|^No"),
    (1, "No, but we anticipate setting one in the next 2 years|No, but we are reporting another target.*science-based"),
    (2, "Yes.*not.*approved"),
    (3, "^Yes$|Yes"),
)
SCIENCE_BASED_ABSOLUTE_CODES = (
    (0, "Question not applicable|Hidden Answer|Don't know|No.*do not anticipate.*next 2 years|^No"),
    (1, "No, but we anticipate setting one in the next 2 years|No, but we are reporting another target.*science-based"),
    (2, "Yes.*not.*approved"),
    (3, "^Yes$|Yes.*has been approved"),
)
ACTIVE_TARGET_CODES = (
    (0, "^No$|No target|Question not applicable|Hidden Answer|Don't know"),
    (1, "^Intensity target$|Intensity target|Renewable"),
    (2, "^Absolute target$|Absolute target"),
    (3, "Both|absolute and intensity|absolute.*intensity"),
)

# Scope 3 categories. A figure exists when any "seen" category is present and
# sums the "summed" categories.
SCOPE3_UPSTREAM_SUMMED = ("Other (upstream)", "Purchased goods and services", "Upstream leased assets", "Upstream transportation and distribution", "Waste generated in operations", "Fuel-and-energy-related activities (not included in Scope 1 or 2)", "Franchises", "Employee commuting", "Capital goods", "Business travel")
SCOPE3_UPSTREAM_SEEN = SCOPE3_UPSTREAM_SUMMED + ("Capital equipment", "Employee commuting and teleworking", "Energy-related activities not included in scope 2", "Leased assets (Scope 1 emissions of the lessee)", "Other: Air travel", "Purchased goods & services - cradle-to-gate emissions", "Purchased goods & services - direct supplier emissions", "Transportation & distribution of inputs & waste generated in operations", "Other: Water consumption", "Other: Water consumption and wastewater treatment")
SCOPE3_DOWNSTREAM_SUMMED = ("Other (downstream)", "Downstream leased assets", "Downstream transportation and distribution", "End of life treatment of sold products", "Investments", "Processing of sold products", "Use of sold products")
SCOPE3_DOWNSTREAM_SEEN = SCOPE3_DOWNSTREAM_SUMMED + ("Disposal of sold products at the end of their life", "Leased assets (Scope 1 emissions of the lessor)", "Transportation & distribution of sold products", "Use of sold goods and services")

# Values that make a verification field count as "not verified".
NOT_VERIFIED_2020 = ("0.0", "Question not applicable", "Not verified")
NOT_VERIFIED = ("Question not applicable", "Not verified")

# Survey audience in a file name.
INVESTOR_PATTERN = "Inv|Investor"
SUPPLY_CHAIN_PATTERN = "Supply Chain|SC"

# Six-digit item codes in headers of the environmental table.
HEADER_CODES = {
    "319407": "tru_scope1_intensity",
    "319409": "tru_scope3_upstream_intensity",
    "319408": "tru_scope2_loc_intensity",
    "319413": "tru_scope1_absolute",
    "319414": "tru_scope2_loc",
    "319415": "tru_scope3_upstream",
    "319522": "tru_revt",
    "319550": "tru_waste_landfill",
    "319567": "tru_water_purchased",
    "326738": "tru_scope3_downstream_intensity",
    "326737": "tru_scope3_downstream_absolute",
    "368314": "tru_scope2_market_intensity",
    "367750": "tru_scope2_market",
}

# Output schema of the summary table.
SUMMARY_COLUMNS = ("account no", "name", "country", "status", "region", "public", "samples", "submitted date", "activities", "sectors", "industries", "primary activity", "primary sector", "primary industry", "primary questionnaire sector", "primary ticker", "primary isin", "bbid", "isin", "ticker", "filename", "discloser id", "primary expansion", "secondary expansions", "complexity", "documents", "version", "ammended date", "program_name", "project_year", "authority types", "minimum tier")

# Climate-action indicators and their grouping into category percentages.
ANSWER_INDICATORS = (
    "has_board_oversight", "has_strategy_integration", "uses_scenario_analysis",
    "has_risk_process", "identified_climate_risks", "identified_climate_opportunities",
    "has_emissions_target", "has_internal_carbon_price", "has_reduction_initiatives",
    "has_low_carbon_products", "engages_value_chain", "engages_policy",
)
# Question code behind each answer indicator; the answer that sets it is "Yes".
ANSWER_QUESTIONS = (
    ("has_board_oversight", "C1.1"),
    ("has_strategy_integration", "C3.1"),
    ("uses_scenario_analysis", "C3.1a"),
    ("has_risk_process", "C2.1"),
    ("identified_climate_risks", "C2.3"),
    ("identified_climate_opportunities", "C2.4"),
    ("has_emissions_target", "C4.1"),
    ("has_internal_carbon_price", "C11.3"),
    ("has_reduction_initiatives", "C4.3"),
    ("has_low_carbon_products", "C4.5"),
    ("engages_value_chain", "C12.1"),
    ("engages_policy", "C12.3"),
)
LABEL_INDICATORS = (
    ("has_netzero_target", "netzero_reduction", "net-zero"),
    ("has_renewable_initiative", "renewable", "LABEL_1"),
    ("has_specific_disclosure", "climate_specificity", "spec"),
    ("makes_environmental_claims", "environmental_claims", "yes"),
)
INDICATOR_CATEGORIES = (
    ("governance_pct", ("has_board_oversight",)),
    ("strategy_pct", ("has_strategy_integration", "uses_scenario_analysis")),
    ("risk_mgmt_pct", ("has_risk_process", "identified_climate_risks", "identified_climate_opportunities")),
    ("metrics_pct", ("has_emissions_target", "has_internal_carbon_price", "has_netzero_target")),
    ("implementation_pct", ("has_reduction_initiatives", "has_low_carbon_products", "has_renewable_initiative")),
    ("engagement_pct", ("engages_value_chain", "engages_policy")),
)
# State by number of key indicators present: (at most, state).
MATURITY_STATES = ((1, "Beginner"), (3, "Developing"), (5, "Advanced"), (None, "Leader"))
KEY_INDICATORS = (
    "has_board_oversight", "has_strategy_integration", "has_risk_process", "has_emissions_target",
    "has_netzero_target", "has_reduction_initiatives", "has_internal_carbon_price",
)

# Points per label in the rhetoric and action scores.
RHETORIC_POINTS = (("environmental_claims", "yes", 1.0), ("climate_sentiment", "opportunity", 1.0))
ACTION_POINTS = (
    ("netzero_reduction", "net-zero", 2.0),
    ("netzero_reduction", "reduction", 1.0),
    ("renewable", "LABEL_1", 1.0),
    ("climate_specificity", "spec", 1.0),
    ("transition", "LABEL_1", 1.0),
)

# Matching parameters used for the survey workbooks.
MATCH_WEIGHTS = {"d_col": 1.7, "s_col": 1.8, "s_field": 0.3, "s_ctx": 1.8}
MATCH_SAMPLES = 4
MATCH_WINDOW = 1
MATCH_THRESHOLD = 0.24

# p-value stars: (below, stars).
STARS = ((0.0001, "****"), (0.001, "***"), (0.01, "**"), (0.05, "*"))

# Two-sided 95 % Student t factors by degrees of freedom; beyond the last row
# the normal factor applies with its first-order correction.
T_FACTORS_95 = (
    12.7062047, 4.3026527, 3.1824463, 2.7764451, 2.5705818, 2.4469119, 2.3646243, 2.3060041,
    2.2621572, 2.2281389, 2.2009852, 2.1788128, 2.1603687, 2.1447867, 2.1314495, 2.1199053,
    2.1098156, 2.1009220, 2.0930241, 2.0859634, 2.0796138, 2.0738731, 2.0686576, 2.0638986,
    2.0595386, 2.0555294, 2.0518305, 2.0484071, 2.0452296, 2.0422725,
)
Z_FACTOR_95 = 1.9599640
