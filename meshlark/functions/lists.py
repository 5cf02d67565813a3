"""Word lists, codes and thresholds that results depend on. Pass others as arguments where they differ."""

# fixed values: token classes of company names
LEGAL = """ltd limited llc lp llp inc incorporated co cos corp corporation company
pvt private plc sa ag gmbh bv nv oy ab as spa srl kk pte""".split()
INDUSTRY = """pharma pharmas pharmaceutical pharmaceuticals pharmaceutica pharm
lab labs laboratory laboratories
bio biotech biotechnology biologics biological biosciences
tech technology technologies
science sciences life lifescience healthcare health
medical medicine medicines drug drugs chemical chemicals chem
industries industry manufacturing mfg works
group holding holdings international intl worldwide global enterprises""".split()
GEO = """wuxi shijiazhuang chengdu zhuhai tianjin shanghai beijing nanjing hangzhou
jiangsu zhejiang shandong hebei guangdong sichuan mongolia inner
china chinese sinopharm-cn india indian netherlands dutch spain spanish
sikkim dewas nawashahr toansa punjab gujarat hyderabad mumbai baddi
north south east west central new old""".split()
STOP = "the a an of and for prev previously formerly fka nee dba aka".split()

# fixed values: words of dosage forms that a generic name's key leaves out
FORM_WORDS = """injection injectable tablet tablets capsule capsules
solution suspension syrup elixir cream ointment gel
patch inhalation aerosol powder kit oral intravenous
iv im subcutaneous topical ophthalmic otic nasal
rectal vaginal extended release delayed chewable for
concentrate emulsion lyophilized single dose vial syringe
prefilled auto injector pen spray drops lotion foam""".split()

# fixed values: charge codes, drug industry prefixes, severities
MFG_CHARGES, PAPER_CHARGES = ["27", "3280"], ["118", "472"]
DRUG_INDUSTRIES = [str(i) for i in range(55, 67)]
SIGNAL_SEMANTICS = {
    "import_refusal": "event",
    "import_refusal_paperwork": "event",
    "regulatory_action": "event",
    "news_event": "event",
    "recall": "event",
    "shortage": "state",
    "inspection_classification": "state",
}
ADVERSE_SHORTAGE = ["current", "to be discontinued"]
EVENT_WINDOW_DAYS, SHARE_GT = 90, 0.75

# fixed values: designated and other countries (ISO3) of the eligibility flag, and the region to move away from
DESIGNATED = """AUT BEL BGR CAN HRV CYP CZE DNK EST FIN FRA DEU GRC HUN IRL ITA LVA LTU LUX MLT NLD POL PRT ROU SVK SVN ESP SWE
GBR CHE NOR ISL JPN KOR SGP AUS NZL ISR MEX CHL PER COL PAN DOM CRI GTM HND NIC SLV MAR BHR OMN TWN HKG USA""".split()
NOT_DESIGNATED = "CHN IND RUS BRA ARG THA VNM IDN MYS".split()
REGION_TO_LEAVE = ["CHN", "IND"]

# fixed values: node id grammar and relations
NODE_PATTERNS = {
    "^drug:[a-z0-9-]+$": "drug",
    "^product:ndc:[a-z0-9-]+$": "product",
    "^api:[a-z0-9-]+$": "api",
    "^precursor:[a-z0-9-]+$": "precursor",
    "^company:fei:\\d+$": "company",
    "^company:duns:\\d+$": "company",
    "^company:name:[a-z0-9-]+$": "company",
    "^country:[a-z]{2}$": "country",
    "^facility:fei:\\d+$": "facility",
}
RELATIONS = "feeds produced_by formulated_into marketed_as markets incorporated_in active_in labeled_by operated_by hosts".split()
REVERSED, WEAK = ["produced_by"], ["marketed_as", "formulated_into"]
DOWNSTREAM = ["feeds", "active_in", "formulated_into"]

# fixed values: storage classes (class, temp_c_min, temp_c_max, excursion min and max, mkt_c_max, rh_pct_max)
STORAGE_CLASSES = [
    ("crt", 20.0, 25.0, 15.0, 30.0, 25.0, 60.0),
    ("cool", 8.0, 15.0, None, None, 15.0, 60.0),
    ("refrigerated", 2.0, 8.0, None, None, 8.0, None),
    ("frozen", -25.0, -10.0, None, None, -10.0, None),
]
ACTIVATION, GAS = 83144.0, 8.314
STALE_S, DWELL_S, CROSS_CHECK_C, WINDOW_S, MIN_WINDOW_S, HISTORY_CAP = 30, 8, 3.0, 86400, 3600, 20000
STATUS_RANK = ["mkt_breach", "sensor_fault", "excursion", "stale", "offline", "ok"]

# fixed values: patterns of words and endings that place names in addresses carry and a gazetteer does not
CITY_NOISE = r"(?i)\b(city|district|dist|county|province|prefecture|town|village|industrial|zone|park|tehsil|taluka|mandal|nagar|p\.?o\.?|post|near|opp|road|rd|street|st|no)\b\.?"
STRIP_SUFFIX = r"(?i)-(shi|si|gu|ku|do|gun|ken|fu)$"

# fixed values: parts of a key whose value never reaches a log, and what stands there instead
SECRET_HINTS = ["api_key", "apikey", "token", "secret", "password", "authorization"]
REDACTED = "[redacted]"

# fixed values: company suffixes as their owners write them, by their capitals
SUFFIX = {
    "GMBH": "GmbH", "SPA": "SpA", "SRL": "Srl", "SLU": "SLU", "SL": "SL", "SA": "SA", "AG": "AG",
    "BV": "BV", "NV": "NV", "LTD": "Ltd", "LTDA": "Ltda", "LLC": "LLC", "INC": "Inc", "CO": "Co",
    "PVT": "Pvt", "PTE": "Pte", "PLC": "PLC", "AS": "AS", "AB": "AB", "OY": "Oy", "KG": "KG",
    "DE": "de", "CV": "CV", "USA": "USA", "UK": "UK", "API": "API", "ACS": "ACS", "DSM": "DSM",
}
