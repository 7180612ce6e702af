"""Word lists, label maps and constants that decide results.

They are plain data in their natural order; order matters wherever "first hit wins".
Every operator takes them as arguments, so a deployment can pass its own lists.
"""

ROLE_FAMILIES = {
    "computer_vision": [
        "computer vision engineer", "vision engineer", "computer vision scientist",
        "vision scientist", "ml engineer vision", "ai engineer vision",
    ],
    "perception": [
        "perception engineer", "perception scientist", "autonomy perception engineer",
        "multimodal perception engineer", "visual perception engineer",
    ],
    "multimodal_ai": [
        "multimodal ai engineer", "multimodal research engineer",
        "research engineer multimodal ai", "foundation model engineer", "applied ai engineer",
    ],
    "mapping_localization": [
        "mapping and localization engineer", "localization engineer", "slam engineer",
        "mapping engineer", "state estimation engineer",
    ],
    "three_d_vision": [
        "3d vision engineer", "geometry engineer", "reconstruction engineer",
        "depth perception engineer",
    ],
    "robotics_ai": ["robotics engineer", "robot perception engineer", "robot learning engineer"],
}

DOMAINS = {
    "computer vision": ["image understanding", "visual ai", "vision models"],
    "multimodal perception": ["sensor fusion", "camera lidar radar", "perception stack"],
    "3d vision": ["3d perception", "geometry", "reconstruction", "depth estimation"],
    "slam": ["visual slam", "mapping", "localization", "odometry"],
    "robotics": ["autonomy", "robot perception", "robotics ai"],
    "edge deployment": ["real-time inference", "embedded ai", "on-device inference"],
    "generative ai": ["foundation models", "vision-language models", "multimodal llms"],
}

INDUSTRIES = {
    "autonomous driving": ["self-driving", "autonomy", "av"],
    "robotics": ["warehouse robotics", "industrial robotics", "robot systems"],
    "automotive": ["vehicle systems", "mobility"],
    "industrial ai": ["manufacturing ai", "inspection ai"],
    "mapping": ["geospatial", "hd maps", "navigation"],
}

SKILLS = {
    "programming_languages": ["python", "c++", "c", "rust", "java", "sql"],
    "frameworks": ["pytorch", "tensorflow", "opencv", "onnx", "ros", "cuda", "triton"],
    "cloud": ["aws", "gcp", "azure", "docker", "kubernetes"],
    "ml_topics": [
        "deep learning", "computer vision", "multimodal ai", "3d vision", "slam",
        "sensor fusion", "tracking", "detection", "segmentation", "classification",
    ],
    "leadership": ["leadership", "mentoring", "hiring", "tech lead", "roadmap"],
}

SENIORITY_VALUES = {
    "intern": 10, "junior": 25, "associate": 35, "mid": 50, "engineer": 60, "senior": 78,
    "staff": 88, "principal": 95, "lead": 85, "manager": 72, "director": 98,
}
SENIORITY_ORDER = ["principal", "staff", "senior", "lead", "mid", "junior", "intern"]

LANGUAGES = ["english", "german", "french", "spanish"]

CURRENCY_SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP"}

GERMAN_TITLE_WORDS = {
    "engineer": "ingenieur",
    "research engineer": "forschungsingenieur",
    "computer vision": "computer vision",
    "perception": "perception",
    "mapping": "mapping",
    "localization": "lokalisierung",
}

BROADER_QUERIES = [
    "computer vision engineer autonomous driving germany",
    "multimodal perception engineer robotics",
    "3d vision engineer mapping slam",
    "ai engineer generative perception automotive",
    "ml engineer edge deployment computer vision",
    "research engineer visual perception",
]

TERM_STOP_WORDS = [
    "and", "the", "with", "for", "from", "that", "this", "have", "into", "across", "using",
    "built", "developed", "worked", "led",
]

UNRELATED_TITLE_WORDS = ["account executive", "recruiter", "sales", "hr", "marketing"]

SECTION_HEADINGS = {
    "responsibilities": ["responsibilities", "what you will do", "what you'll do"],
    "minimum_qualifications": [
        "minimum qualifications", "requirements", "must have", "basic qualifications",
    ],
    "preferred_qualifications": [
        "preferred qualifications", "nice to have", "preferred skills",
    ],
}

REQUIREMENT_MARKERS = [
    "require", "qualification", "experience", "proficiency", "responsible", "build", "develop",
    "design", "implement", "maintain", "knowledge", "familiar", "must", "preferred",
    "nice to have",
]
VAGUE_TERMS = [
    "communication", "communicate", "team player", "collaboration", "collaborative",
    "self-starter", "fast-paced", "passion",
]
EMPHASIS_TERMS = [
    "required", "must", "essential", "excellent", "strong", "demonstrated", "proven",
    "responsible for",
]

OVERLAP_IGNORED = ["with", "from", "that", "this", "have", "using", "build", "built", "role", "work"]
CLAIM_IGNORED = [
    "have", "with", "using", "built", "build", "developed", "worked", "experience", "systems",
    "system", "role", "work", "and", "the", "for",
]

FIT_LABEL_SCORES = {"realistic": 90.0, "stretch": 65.0, "poor_fit": 25.0, "unknown": 50.0}
STATUS_SCORES = {"strong_match": 1.0, "partial_match": 0.6, "uncertain": 0.3, "missing": 0.0}
STATUS_ALIASES = {
    "strong": "strong_match", "strong match": "strong_match", "strong_match": "strong_match",
    "partial": "partial_match", "partial match": "partial_match",
    "partial_match": "partial_match", "missing": "missing", "uncertain": "uncertain",
    "unknown": "uncertain",
}

URL_JOB_HINTS = [
    "job", "jobs", "career", "careers", "vacanc", "opening", "position", "stellen", "jobsearch",
]
POSTING_WORD_HINTS = ["responsibilities", "qualifications", "apply"]
LISTING_PAGE_TITLES = ["unknown title", "vacancies", "careers", "stellenangebote"]

FILTER_KINDS = {
    "search_text": ["search", "keyword", "query", "suche"],
    "country_region": ["country", "region", "country / region", "land"],
    "city_location": ["city", "location", "standort", "ort"],
    "company": ["company", "brand", "unternehmen"],
    "category": ["category", "department", "function", "bereich", "job family", "team"],
    "work_mode": ["remote", "hybrid", "onsite", "arbeitsmodell"],
}

DISCOVERY_TEMPLATES = [
    "{keyword} companies {region}", "{keyword} jobs {region}",
    "{keyword} company careers {region}", "{keyword} robotics company {region}",
    "{keyword} ai company {region}",
]
DISCOVERY_QUERIES = [
    "site:boards.greenhouse.io computer vision Germany",
    "site:job-boards.eu.greenhouse.io robotics Germany",
    "site:boards.greenhouse.io multimodal ai Europe",
    "site:jobs.lever.co computer vision Germany",
    "site:jobs.ashbyhq.com robotics Germany",
    "top robotics startups Germany", "top computer vision companies Germany",
    "slam companies Europe",
]
DEFAULT_REGIONS = ["Germany", "Europe"]
NON_COMPANY_WORDS = [
    "jobs", "careers", "career", "hiring", "linkedin", "indeed", "glassdoor", "germany",
    "europe", "remote", "team", "page", "blog", "news", "startup", "startups", "company",
    "companies", "vision", "robotics", "ai", "driving", "munich", "berlin", "hamburg",
    "stuttgart", "job", "boards", "greenhouse", "lever",
]
COMPANY_SUFFIXES = [
    "GmbH", "Inc", "Ltd", "LLC", "AG", "SE", "PLC", "Technologies", "Technology", "Systems",
    "Group", "Corp", "Company",
]
COMPANY_SEEDS = [
    "NavVis", "Agile Robots", "NEURA Robotics", "Franka Robotics", "KUKA", "Bosch",
    "Continental", "Cariad", "Aptiv", "Innoviz", "Wayve", "Applied Intuition", "Tesla",
    "NVIDIA", "Intrinsic", "ANYbotics",
]
COMPANY_NAME_HINTS = [
    "robot", "vision", "autonomous", "mapping", "slam", "ai", "lidar", "perception",
]

RANKED_CSV_COLUMNS = [
    "overall_score", "disposition", "title", "company", "location", "work_mode", "source",
    "application_url", "rules_based_score", "embedding_similarity_score",
    "llm_latency_seconds", "title_match_score", "skills_overlap_score", "domain_match_score",
    "seniority_fit_score", "location_fit_score", "constraints_fit_score", "why_match",
    "missing_skills", "recommended_resume_emphasis", "recommended_cover_letter_angle",
]
