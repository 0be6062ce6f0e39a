"""Vocabulary. All tables of this module are fixed values: results depend on every entry and on the order."""

SENIORITY = {
    "intern": ["intern", "internship", "co-op", "coop"],
    "entry": ["entry level", "entry-level", "junior", "jr", "associate", "trainee", "apprentice", "graduate", "new grad", "i", "assistant"],
    "mid": ["mid level", "mid-level", "intermediate", "ii", "iii"],
    "senior": ["senior", "sr", "sr.", "iv", "lead", "specialist iv"],
    "staff": ["staff", "principal", "distinguished", "fellow"],
    "management": ["head of", "supervisor", "chief", "director", "vp", "vice president", "president", "partner"],
}
SHORT_SENIORITY_TERMS = ["sr", "jr", "ii", "iv", "vp"]

REMOTE_PHRASES = ["100% remote", "fully remote", "remote first", "remote-first", "work from home", "work from anywhere", "wfh", "telecommute", "telework", "virtual position", "remote position", "remote role", "remote opportunity", "remote"]
HYBRID_PHRASES = ["hybrid", "partially remote", "part remote", "flexible hybrid", "days in office", "days per week in the office", "days onsite", "in office 2", "in office 3", "split between", "blend of remote and", "hybrid schedule", "hybrid work"]
ONSITE_PHRASES = ["on site", "on-site", "onsite", "in person", "in-person", "in office", "in-office", "no remote", "not remote", "not a remote", "office based", "office-based"]

EMPLOYMENT_TYPES = {
    "full_time": ["full time", "full-time", "fulltime", "permanent", "regular"],
    "part_time": ["part time", "part-time", "parttime"],
    "contract": ["contract", "contractor", "w2 contract", "1099", "fixed term", "fixed-term", "temporary", "temp", "seasonal"],
    "internship": ["internship", "intern", "co-op"],
    "volunteer": ["volunteer", "unpaid"],
}

REQUIRED_MARKERS = ["required", "requires", "require", "requirement", "must have", "must possess", "must hold", "must be", "mandatory", "is a must", "essential", "minimum qualification", "minimum qualifications", "you must", "we require"]
PREFERRED_MARKERS = ["preferred", "prefer", "a plus", "plus", "nice to have", "nice-to-have", "desirable", "desired", "bonus", "ideally", "ideal candidate", "or equivalent", "equivalent experience", "pursuing", "working toward", "working towards", "progress toward", "progressing toward", "in progress", "candidate", "eligible to sit", "optional", "helpful", "advantageous", "welcome", "would be great", "good to have", "willingness to obtain", "ability to obtain"]
NEGATION_PATTERNS = [r"\bno\s+[\w\s]{0,24}?\brequired\b", r"\bnot\s+required\b", r"\bnot\s+necessary\b", r"\bnot\s+mandatory\b", r"\bdo(?:es)?\s+not\s+require\b", r"\bwithout\s+[\w\s]{0,24}?\brequired\b", r"\bno\s+need\s+for\b"]
REQUIREMENT_HEADINGS = ["requirements", "required qualifications", "minimum qualifications", "qualifications", "what you need", "what you'll need", "must haves", "must-haves", "basic qualifications"]
PREFERENCE_HEADINGS = ["preferred qualifications", "nice to have", "nice-to-haves", "bonus points", "preferred skills", "pluses", "what would set you apart", "extra credit"]

SPONSORSHIP_REFUSALS = ["no sponsorship", "not able to sponsor", "unable to sponsor", "cannot sponsor", "will not sponsor", "does not sponsor", "do not sponsor", "without sponsorship", "no visa sponsorship", "not provide sponsorship", "not offer sponsorship", "must be authorized to work", "must already be authorized", "without the need for sponsorship", "not require sponsorship now or in the future"]
SPONSORSHIP_OFFERS = ["visa sponsorship available", "we sponsor", "will sponsor", "sponsorship available", "offer sponsorship", "provide sponsorship", "h-1b sponsorship", "open to sponsorship"]

US_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY",
    "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY",
    "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC", "puerto rico": "PR",
}
US_PHRASES = ["united states", "usa", "u.s.a.", "u.s.", "us based", "us-based", "united states of america", "remote us", "remote - us", "remote (us)", "us remote", "anywhere in the us", "anywhere in the united states", "us only", "domestic us", "authorized to work in the united states", "must reside in the us"]
NON_US_COUNTRIES = {
    "canada": "CA", "united kingdom": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB", "ireland": "IE", "germany": "DE", "france": "FR", "spain": "ES", "portugal": "PT", "italy": "IT", "netherlands": "NL", "belgium": "BE", "switzerland": "CH", "austria": "AT", "sweden": "SE",
    "norway": "NO", "denmark": "DK", "finland": "FI", "poland": "PL", "czech republic": "CZ", "czechia": "CZ", "romania": "RO", "bulgaria": "BG", "greece": "GR", "hungary": "HU", "ukraine": "UA", "turkey": "TR", "israel": "IL", "india": "IN", "china": "CN", "japan": "JP", "south korea": "KR", "singapore": "SG",
    "malaysia": "MY", "indonesia": "ID", "philippines": "PH", "vietnam": "VN", "thailand": "TH", "australia": "AU", "new zealand": "NZ", "brazil": "BR", "argentina": "AR", "chile": "CL", "colombia": "CO", "peru": "PE", "mexico": "MX", "costa rica": "CR", "south africa": "ZA", "nigeria": "NG", "kenya": "KE",
    "egypt": "EG", "united arab emirates": "AE", "dubai": "AE", "saudi arabia": "SA", "qatar": "QA", "pakistan": "PK", "bangladesh": "BD", "sri lanka": "LK",
}
NON_US_REGIONS = {"emea": "EMEA", "apac": "APAC", "latam": "LATAM"}

COMPANY_SUFFIXES = ["inc", "incorporated", "llc", "l l c", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gmbh", "sa", "ag", "nv", "bv", "srl", "pty", "holdings", "group", "the"]
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gh_src", "gh_jid", "ref", "referrer", "source", "src", "trk", "trackingid", "lever-source", "lever-origin", "session", "sessionid", "sid", "fbclid", "gclid", "mc_cid", "mc_eid", "recruiter", "campaign", "from", "utm_referrer"]
ATS_HOSTS = ["greenhouse.io", "lever.co", "ashbyhq.com", "myworkdayjobs.com", "smartrecruiters.com", "workable.com", "recruitee.com", "bamboohr.com", "breezy.hr", "applytojob.com", "teamtailor.com", "personio.de", "rippling.com", "usajobs.gov", "jobs.polymer.co"]

BLOCK_TAGS = ["p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"]
SKIPPED_TAGS = ["script", "style", "head", "title"]
PERIODS_A_YEAR = {"year": 1, "month": 12, "week": 52, "day": 260, "hour": 2080}

WEIGHTS = {
    "title_match": 10.0, "related_title_match": 6.0, "keyword_match": 2.0, "required_skill_match": 4.0, "responsibility_match": 3.0, "industry_match": 2.0, "target_company_match": 8.0,
    "preferred_workplace": 5.0, "preferred_location": 4.0, "salary_disclosed": 1.5, "salary_above_floor": 3.0, "freshness": 3.0, "authority_bonus": 2.0, "uncertainty_penalty": -4.0,
}
