"""Names, patterns and word lists that results depend on, stated as they are."""

from __future__ import annotations

# ---- fixed values: vendor platforms by rank, their hosts, and parts of path and query ----
#: (label, hosts, parts) by rank
RULES = [
    ("Workday", ["myworkdayjobs.com", "myworkdaysite.com", "myworkday.com", "workday.com"], ["/wday/"]),
    ("Greenhouse", ["greenhouse.io", "grnh.se"], ["/embed/job_board", "/embed/job_app"]),
    ("Lever", ["lever.co"], []),
    ("Ashby", ["ashbyhq.com"], ["/ashby_embed"]),
    ("iCIMS", ["icims.com"], ["/icims/"]),
    ("UltiPro", ["ultipro.com", "ultipro.ca"], ["/jobboard/"]),
    ("UKG", ["ukg.com", "ukgpro.com", "ukgpro.ca", "ukg.net"], []),
    ("SmartRecruiters", ["smartrecruiters.com"], []),
    ("SAP SuccessFactors", ["successfactors.com", "successfactors.eu", "sapsf.com", "sapsf.eu", "jobs.sap.com"], ["/sfcareer/", "/career?company=", "/careers?company="]),
    ("Taleo", ["taleo.net", "taleo.com"], ["/careersection/"]),
    ("Oracle", ["oraclecloud.com", "oracle.com"], ["/hcmui/candidateexperience", "/recruitingce"]),
    ("Jobvite", ["jobvite.com", "jobvite.co"], []),
    ("Teamtailor", ["teamtailor.com"], []),
    ("BambooHR", ["bamboohr.com", "bamboohr.co.uk"], ["/jobs/embed2.php"]),
    ("Recruitee", ["recruitee.com"], []),
    ("Workable", ["workable.com"], []),
    ("Dayforce", ["dayforcehcm.com", "dayforce.com", "ceridian.com"], ["/candidateportal"]),
    ("ADP Recruiting Management", ["myjobs.adp.com"], []),
    ("ADP", ["adp.com"], ["/mascsr/default/mdf/recruitment/"]),
    ("Cornerstone", ["csod.com", "cornerstoneondemand.com"], ["/ux/ats/careersite"]),
    ("Eightfold", ["eightfold.ai"], ["/careers?pid="]),
    ("Phenom", ["phenompeople.com", "phenomapps.com", "phenom.com"], []),
    ("Paylocity", ["paylocity.com"], []),
    ("Paycom", ["paycomonline.net", "paycomonline.com"], ["/v4/ats/"]),
    ("Paycor", ["recruitingbypaycor.com", "paycor.com", "newtonsoftware.com"], ["/career/careerhome.action", "/career/jobintroduction.action"]),
    ("UKG Ready", ["saashr.com"], []),
    ("isolved", ["isolvedhire.com", "myisolved.com", "isolvedhcm.com"], []),
    ("Asure", ["entertimeonline.com", "asuresoftware.com"], []),
    ("JazzHR", ["applytojob.com", "jazzhr.com", "jazz.co"], []),
    ("Rippling", ["rippling.com", "rippling-ats.com"], []),
    ("Personio", ["personio.de", "personio.com"], []),
    ("Avature", ["avature.net"], ["/careers/searchjobs"]),
    ("Bullhorn", ["bullhornstaffing.com", "bullhorn.com", "bullhorncareerportal.com"], []),
    ("BreezyHR", ["breezy.hr"], []),
    ("Pinpoint", ["pinpointhq.com"], []),
    ("Comeet", ["comeet.co", "comeet.com"], ["/careers-api/"]),
    ("Fountain", ["fountain.com"], []),
    ("NeoGov", ["governmentjobs.com", "neogov.com", "schooljobs.com"], []),
    ("Oleeo", ["oleeo.com", "tal.net"], []),
    ("JobScore", ["jobscore.com"], []),
    ("GoHire", ["gohire.io"], []),
    ("Homerun", ["homerun.co"], []),
    ("Join.com", ["join.com"], []),
    ("Zoho Recruit", ["zohorecruit.com", "zohorecruit.eu", "zohorecruit.in", "zohorecruit.com.au"], ["/recruit/portal/"]),
    ("Manatal", ["manatal.com"], []),
    ("Gem", ["jobs.gem.com"], []),
    ("TalentReef", ["talentreef.com", "jobappnetwork.com"], []),
    ("ApplicantPro", ["applicantpro.com", "applicantpool.com"], []),
    ("ApplicantStack", ["applicantstack.com"], []),
    ("ClearCompany", ["clearcompany.com"], []),
    ("CareerPlug", ["careerplug.com"], []),
    ("Hireology", ["hireology.com"], []),
    ("HRMDirect", ["hrmdirect.com"], []),
    ("SilkRoad", ["silkroad.com", "silkroad-eng.com"], []),
    ("Trakstar Hire", ["recruiterbox.com", "trakstar.com", "trakstarhire.com"], []),
    ("Radancy", ["radancy.com", "talentbrew.com", "tmpwebeng.com"], []),
    ("Indeed", ["indeed.com", "indeed.jobs"], []),
]

#: (label, hosts, parts) by rank
GENERIC, UNKNOWN = "Generic HTML", "Unknown"
PLATFORMS = [name for name, _, _ in RULES]

# ---- fixed values: places ----
US_STATES = [
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "dc", "fl", "ga", "hi", "id", "il", "in", "ia", "ks", "ky", "la", "me", "md",
    "ma", "mi", "mn", "ms", "mo", "mt", "ne", "nv", "nh", "nj", "nm", "ny", "nc", "nd", "oh", "ok", "or", "pa", "ri", "sc", "sd",
    "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy", "as", "gu", "mp", "pr", "vi",
]
CANADIAN_PROVINCES = [
    "ab", "bc", "mb", "nb", "nl", "ns", "nt", "nu", "on", "pe", "qc", "sk", "yt",
]
US_STATE_NAMES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia",
    "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts",
    "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "ohio", "oklahoma", "oregon",
    "pennsylvania", "tennessee", "texas", "utah", "vermont", "virginia", "washington", "wisconsin", "wyoming", "new hampshire",
    "new jersey", "new mexico", "new york", "north carolina", "north dakota", "rhode island", "south carolina", "south dakota",
    "west virginia", "district of columbia", "puerto rico",
]
#: alias -> country
COUNTRY_OF = {
    "united states": "United States", "united states of america": "United States", "usa": "United States",
    "u.s.a.": "United States", "u.s.": "United States", "us": "United States", "america": "United States",
    "united kingdom": "United Kingdom", "uk": "United Kingdom", "u.k.": "United Kingdom", "great britain": "United Kingdom",
    "england": "United Kingdom", "scotland": "United Kingdom", "wales": "United Kingdom", "northern ireland": "United Kingdom",
    "gb": "United Kingdom", "canada": "Canada", "mexico": "Mexico", "brazil": "Brazil", "brasil": "Brazil",
    "argentina": "Argentina", "chile": "Chile", "colombia": "Colombia", "costa rica": "Costa Rica", "india": "India",
    "china": "China", "hong kong": "Hong Kong", "taiwan": "Taiwan", "japan": "Japan", "south korea": "South Korea",
    "korea": "South Korea", "singapore": "Singapore", "malaysia": "Malaysia", "indonesia": "Indonesia", "thailand": "Thailand",
    "vietnam": "Vietnam", "viet nam": "Vietnam", "philippines": "Philippines", "australia": "Australia",
    "new zealand": "New Zealand", "ireland": "Ireland", "france": "France", "germany": "Germany", "deutschland": "Germany",
    "spain": "Spain", "espana": "Spain", "portugal": "Portugal", "italy": "Italy", "netherlands": "Netherlands",
    "the netherlands": "Netherlands", "holland": "Netherlands", "belgium": "Belgium", "luxembourg": "Luxembourg",
    "switzerland": "Switzerland", "austria": "Austria", "sweden": "Sweden", "norway": "Norway", "denmark": "Denmark",
    "finland": "Finland", "iceland": "Iceland", "poland": "Poland", "czech republic": "Czech Republic",
    "czechia": "Czech Republic", "slovakia": "Slovakia", "hungary": "Hungary", "romania": "Romania", "bulgaria": "Bulgaria",
    "greece": "Greece", "turkey": "Turkey", "ukraine": "Ukraine", "israel": "Israel",
    "united arab emirates": "United Arab Emirates", "uae": "United Arab Emirates", "saudi arabia": "Saudi Arabia",
    "qatar": "Qatar", "egypt": "Egypt", "south africa": "South Africa", "nigeria": "Nigeria", "kenya": "Kenya",
    "morocco": "Morocco",
}
PLACEHOLDERS = [
    "remote", "various", "various locations", "multiple", "multiple locations", "worldwide", "global", "anywhere", "flexible",
    "tbd", "n/a", "na", "none",
]
LOCATION_SEPARATOR = r"(?i)\s*(?:;|\||\bor\b|/)\s*"
LOCATION_COUNT = r"^\d+\s+locations?$"
LOCATION_QUALIFIER = r"(?i)^\s*(?:fully\s+)?(?:remote|hybrid|on[\s-]?site|virtual|field|home[\s-]?based|telecommute)\s*(?:[-–—:,]\s*|\s+in\s+)"
PARENTHETICAL = r"\s*\([^)]*\)"

# ---- fixed values: links and titles ----
JOB_URL_HINTS = [
    "/job/", "/jobs/", "/job-", "/jobs-", "jobid=", "job_id=", "jobcode=", "/careers/", "/career/", "/opening", "/openings/",
    "/position", "/positions/", "/vacanc", "/requisition", "/opportunit", "/apply/", "/joblisting", "/job-detail", "/jobdetail",
    "/jobposting", "/viewjob",
]
NAVIGATION_TEXT = [
    "apply", "apply now", "apply here", "view", "view job", "view all", "view all jobs", "view details", "see all",
    "see all jobs", "see more", "learn more", "read more", "more", "more info", "details", "job details", "search", "search jobs",
    "all jobs", "open positions", "current openings", "careers", "career", "jobs", "next", "previous", "prev", "back", "home",
    "submit", "sign in", "log in", "login", "register", "share", "email", "print", "save", "save job", "join our team", "join us",
    "click here", "locations", "students", "graduates", "diversity & inclusion", "our team", "meet our team", "life at",
]
NAVIGATION_PATTERN = (
    r"(?i)^\s*(?:apply\b|(?:view|see|read|learn|find|show)\b[^|]{0,20}?\b(?:apply|more|details?|jobs?)\b"
    r"|more\s+(?:info|details)|full\s+(?:details|description))"
)
LOCATION_HINT = r"(?i)location|city|region|address|office|where|geo|place"
TITLE_HINT = r"(?i)job[-_]?title|position[-_]?title|posting[-_]?title|role[-_]?title|\btitle\b|\bheading\b"
LOCATION_TEXT = r"\b([A-Z][A-Za-z.'\-]+(?:[ ][A-Z][A-Za-z.'\-]+){0,3},\s*(?:[A-Z]{2}\b|[A-Z][a-z]+(?:[ ][A-Z][a-z]+){0,2}))"
NON_TITLES = [
    "careers", "career", "jobs", "job", "search", "search jobs", "home", "all jobs", "open positions", "apply", "apply now",
    "view all", "view all jobs", "login", "sign in", "register", "about", "about us", "contact", "contact us", "privacy", "terms",
    "cookies", "help", "benefits", "culture", "our team", "join us", "join our team", "more", "next", "previous", "back",
    "english", "united states", "remote",
]
CAREER_WORDS = [
    "careers", "career", "jobs", "job openings", "join us", "join our team", "join the team", "work with us", "work for us",
    "work here", "open positions", "open roles", "current openings", "employment", "vacancies", "vacancy", "opportunities",
    "hiring", "we're hiring", "recruitment", "recruiting", "apply", "apply now", "life at", "working at", "talent", "people",
]
CAREER_PATHS = [
    "/careers", "/careers/", "/jobs", "/careers/jobs", "/company/careers", "/about/careers", "/about-us/careers", "/en/careers",
    "/en-us/careers", "/join-us", "/work-with-us", "/employment", "/opportunities", "/vacancies", "/careers/open-positions",
    "/open-positions", "/current-openings", "/who-we-are/careers",
]
NEGATIVE_WORDS = [
    "privacy", "cookie", "terms", "blog", "news", "press", "investor", "sitemap", "login", "sign in", "fraud", "scam", "policy",
    "alumni", "internship report",
]
CAREER_PATH_PATTERN = r"/(?:careers?|jobs|employment|vacancies)(?:/|$|\?)"
LISTING_EVIDENCE = (
    r"(?i)\b(?:apply|apply now|open position|current opening|job title|view job|"
    r"full[- ]time|part[- ]time|department|requisition|job id)\b"
)
NEXT_LABELS = ["next", "next page", "next »", "next >", "›", "»", ">", "load more", "show more", "more"]

# ---- fixed values: pages that bar the way ----
CHALLENGE_TITLES = [
    "human verification", "just a moment", "attention required", "checking your browser", "verifying you are human",
    "one moment, please", "access denied", "security check", "please wait",
]
CHALLENGE_MARKUP = ["awswaf.com/", "challenge-platform", "cf-browser-verification", "_incapsula_resource", "px-captcha"]
CAPTCHA_MARKUP = ["captcha.awswaf.com", 'id="captcha"', "g-recaptcha", "h-captcha", "hcaptcha.com", "recaptcha/api.js"]
WAF_MARKERS = ["awsWafCookieDomainList", "Human Verification", "gokuProps"]

# ---- fixed values: state embedded in pages ----
STATE_VARIABLES = [
    "__NUXT__", "__APOLLO_STATE__", "__INITIAL_STATE__", "__PRELOADED_STATE__", "__INITIAL_DATA__", "__INITIAL_PROPS__",
    "__NEXT_DATA__", "__REDUX_STATE__", "__SERVER_DATA__", "__STATE__", "__DATA__", "__remixContext", "__sveltekit_data",
    "APP_STATE", "PAGE_DATA", "pageData", "initialState", "serverData", "jobsData", "jobData",
]
JSON_ATTRIBUTES = [
    "data-page", "data-props", "data-state", "data-jobs", "data-initial-state", "data-component-props",
]
JSON_SCRIPT_TYPES = [
    "application/json", "application/ld+json", "text/json", "application/x-json",
]
TITLE_KEYS = [
    "title", "jobtitle", "job_title", "name", "positiontitle", "position_title", "postingtitle", "posting_title", "positionname",
    "position_name", "jobname", "job_name", "displayname", "display_name", "roletitle", "role_title", "requisitiontitle",
    "vacancytitle", "advertisedtitle", "headline", "label",
]
URL_KEYS = [
    "url", "absolute_url", "absoluteurl", "joburl", "job_url", "applyurl", "apply_url", "hostedurl", "hosted_url", "canonicalurl",
    "canonical_url", "permalink", "link", "href", "detailurl", "detail_url", "jobpostingurl", "postingurl", "posting_url",
    "externalpath", "external_path", "applylink", "landingpageurl", "joblink", "job_link", "seourl", "path", "slug",
]
LOCATION_KEYS = [
    "location", "locations", "locationname", "location_name", "joblocation", "job_location", "joblocations", "postinglocations",
    "posting_locations", "requisitionlocations", "worklocations", "work_locations", "primarylocation", "primary_location", "city",
    "cityname", "locationtext", "location_text", "formattedlocation", "workplace", "locationsstext", "officelocation", "office",
    "region", "worklocation", "locationdescription", "geo", "address", "locationsstring",
]
COUNTRY_KEYS = [
    "country", "countryname", "country_name", "countrycode", "locationcountry",
]
SIGNAL_KEYS = {
    *LOCATION_KEYS, *COUNTRY_KEYS,
    "department", "departments", "departmentname", "team", "teamname", "employmenttype", "employment_type", "jobtype", "job_type",
    "worktype", "contracttype", "schedule", "shift", "category", "categories", "jobcategory", "function", "jobfunction",
    "discipline", "requisitionid", "requisition_id", "reqid", "req_id", "jobid", "job_id", "jobcode", "job_code", "shortcode",
    "postingid", "posting_id", "externalid", "vacancyid", "opportunityid", "positionid", "dateposted", "date_posted", "postedon",
    "posted_on", "posteddate", "publisheddate", "published_at", "publishedat", "createdat", "created_at", "updatedat",
    "firstpublished", "livedate", "salary", "compensation", "payrange", "pay_range", "remote", "isremote", "is_remote",
    "workplacetype", "seniority", "experience", "applyurl", "apply_url", "applylink", "brand", "businessunit",
}
ADDRESS_PARTS = [
    ["addressLocality", "cityName", "city", "locality", "town", "municipality"],
    ["addressRegion", "countrySubdivisionLevel1", "stateProvince", "state", "province", "region", "stateCode"],
    ["addressCountry", "country", "countryName", "countryCode"],
]
TEXT_KEYS = [
    "name", "longName", "label", "text", "value", "title", "displayName", "formattedAddress", "address", "city", "cityName",
    "locality", "description", "fullName", "shortName", "codeValue",
]
BUNDLE_SUFFIXES = [".js", ".mjs", ".jsx", ".ts"]
ENDPOINT = (
    r"(?i)[\"'`](/(?:[\w.\-]+/)*(?:api|graphql|jobs|search|positions|openings|postings|vacancies|careers|widgets|services|rest)"
    r"[\w./\-]*(?:\?[\w=&%.\-+]*)?)[\"'`]"
)

# ---- fixed values: reports ----
NO_JOBS_DETAIL = "crawled successfully; board advertises no jobs"
OUTCOMES = ["jobs", "no open jobs", "unsupported platform", "technical failure", "unknown platform"]
REPORT_COLUMNS = ["Company", "Website", "Career URL", "IT LINK", "Crawled URL", "Seed Field", "Platform", "Outcome", "Detail", "Seconds"]
REPORT_FILES = {
    "no open jobs": "no_open_jobs.csv", "unsupported platform": "unsupported_platforms.csv",
    "technical failure": "technical_failures.csv", "unknown platform": "unknown_platforms.csv",
}
FAILURE_COLUMNS = ["Company", "Website", "Career URL", "IT LINK", "Platform", "Failure Reason"]
EXPORT_COLUMNS = {
    "company_name": "Company Name", "job_title": "Job Title", "location": "Location", "country": "Country",
    "job_url": "Job URL", "career_page_url": "Career Page URL", "platform": "Platform",
}
HEADER_ALIASES = {
    "company": ["Company Name", "Company", "Name"],
    "website": ["Website", "Company Website", "Web Site", "URL"],
    "career_url": ["Career Page URL", "Careers Page URL", "Careers / Jobs URL", "Careers URL", "Career URL", "Careers Page", "Jobs URL", "Job URL"],
    "it_link": ["IT LINK", "IT Link", "ATS Link", "ATS URL", "Job Board URL"],
}
SEED_FIELDS = ["it_link", "career_url", "website"]
NEEDS_A_BROWSER = r"(?i)browser-driven|client-side|needs a browser|bot challenge|human verification"
