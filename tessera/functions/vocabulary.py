"""Word lists, patterns and constants that decide results, as plain text.

Lists here are data. Results that name cities, departments, tracking keys or gates depend on them value by value."""

# --- fixed values: locations
REMOTE_TERMS = ["remote", "anywhere", "work from home", "wfh", "fully distributed", "distributed team", "distributed company", "distributed workforce"]
CITY_ALIASES = {
    "tel aviv": ["tel aviv-yafo", "tel aviv yafo", "tel aviv-jaffa", "tel aviv", "tel-aviv", "telaviv", "tlv", "תל אביב"],
    "herzliya": ["herzliya", "herzilya", "הרצליה"],
    "haifa": ["haifa", "חיפה"],
    "jerusalem": ["jerusalem", "ירושלים"],
    "raanana": ["raanana", "ra'anana", "רעננה"],
    "petah tikva": ["petah tikva", "petach tikva", "petah-tikva", "פתח תקווה", "פתח תקוה"],
    "netanya": ["netanya", "נתניה"],
    "ramat gan": ["ramat gan", "ramat-gan", "רמת גן"],
    "beer sheva": ["beer sheva", "be'er sheva", "beersheba", "באר שבע"],
    "rehovot": ["rehovot", "רחובות"],
    "yokneam": ["yokneam", "yoqneam", "יקנעם"],
    "kfar saba": ["kfar saba", "כפר סבא"],
    "caesarea": ["caesarea", "קיסריה"],
    "hod hasharon": ["hod hasharon", "הוד השרון"],
    "or yehuda": ["or yehuda", "אור יהודה"],
    "airport city": ["airport city"],
    "modiin": ["modiin", "modi'in", "מודיעין"],
    "lod": ["lod", "לוד"],
    "ness ziona": ["ness ziona", "נס ציונה"],
    "givatayim": ["givatayim", "גבעתיים"],
    "holon": ["holon", "חולון"],
    "bnei brak": ["bnei brak", "בני ברק"],
    "rosh haayin": ["rosh haayin", "rosh ha'ayin", "ראש העין"],
    "ashdod": ["ashdod", "אשדוד"],
    "ashkelon": ["ashkelon", "אשקלון"],
    "eilat": ["eilat", "אילת"],
    "israel": ["israel", "ישראל"],
}

# --- fixed values: job URLs
VOLATILE_QUERY_KEYS = ["t", "_t", "ts", "_ts", "timestamp", "cache", "_cache", "cb", "nocache", "v", "_v", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid"]
JOB_URL_HINT = r"(?i)(job|career|position|opening|vacan|opportunit|\d{3,})"
NON_JOB_HOSTS = ["google.com/maps", "maps.google.com", "goo.gl/maps"]
NON_JOB_SEGMENTS = ["docs", "documentation", "blog", "resources", "resource-library", "legal", "trust-center", "security-center", "press", "newsroom", "case-studies", "case-study", "webinar", "webinars", "community", "partners", "glossary", "pricing", "integrations", "use-cases", "customer-stories", "help-center", "accessibility"]

# --- fixed values: company names
COMPANY_SUFFIXES = ["ltd", "inc", "llc", "group", "technologies", "technology", "labs", "systems", "software", "solutions", "israel", "the"]
AGENCY_MARKERS = ["medulla", "ness technologies", "pwc", "deloitte", "ey israel", "kpmg", "accenture", "talent", "recruit", "staffing", "hr services", "manpower", "experis", "sqlink", "matrix", "john bryce", "aman group"]

# --- fixed values: titles in an export
TITLE_KEEP = ["backend", "back-end", "software engineer", "software developer", "platform", "mlops", "ml engineer", "machine learning engineer", "ai engineer", "infrastructure", "sre", "site reliability", "data engineer", "full stack", "fullstack", "staff", "tech lead", "architect", "devops"]
TITLE_DROP = ["legal", "counsel", "attorney", "sales", "finance", "commission", "animator", "designer", "recruiter", "marketing", "fraud", "project manager"]
TITLE_DROP_UNLESS_ENGINEER = ["analyst"]

# --- fixed values: link labels that are site furniture, calls to action, and words that name a person's job
NAV_LABEL = r"(?i)^(home|about( us)?|contact( us)?|privacy( policy)?|terms( (of (use|service)|and conditions|& conditions))?|cookies?( policy)?|sign ?(in|up)|log ?(in|out)|careers?|jobs?|open (roles|positions)|join us|work with us|register|blog|news|press|resources?|investors?|benefits?|culture|our (team|story|values)|locations?|offices?|leadership|help|faq|support|search( jobs?)?|filter|share|apply( now| today)?|view all|see all|learn more|read more|menu|partners|platform|solutions|webinars?|glossary|services|technology|customers|industries|security|marketing|documentation|accessibility)$"
NAV_PREFIX = r"(?i)^(about( us| the position)?|careers?|blog|news|press|resources?|terms|privacy|cookies?|contact( us)?|sign ?(in|up)|log ?(in|out)|learn more|read more|view all|see all|home( page)?|our (story|team|values|mission)|who we are|join us)\b"
CTA_LABEL = r"(?i)^((book|get|request|schedule) a demo|get started|get in touch|tell me more|more info(rmation)?|view (role|job|details|latest roles))$"
CTA_PREFIX = r"(?i)^(download|read|watch|subscribe|explore|discover|register for)\b"
ROLE_WORD = r"(?i)\b(engineer|engineering|developer|programmer|architect|scientist|researcher|analyst|manager|director|head|lead|leader|chief|officer|president|partner|executive|designer|writer|editor|marketer|recruiter|accountant|controller|counsel|attorney|lawyer|advisor|consultant|coach|trainer|specialist|coordinator|administrator|technician|operator|representative|agent|associate|assistant|intern|student|sdet|devops|sre|qa|pmm?|cto|cfo|ceo|coo|ciso|vp)\b"

# --- fixed values: departments, first match wins
NOT_A_DEPARTMENT = r"(?i)^(management|general|general ?& ?administrative|g ?& ?a|admin(istration)?|(\w+ )*(back |front )?office|corporate|strategy|executive|territory management|students?|interns?(hips?)?|graduates?|freelancers?|other|misc\w*)$"
DEPARTMENT_RULES = [
    (r"security|cyber|ciso|threat|infosec|trust & safety|fraud", "Security"),
    (r"\bsales\b|\bsdr\b|revenue|go.?to.?market|\bgtm\b|business development|channels?\b|partner|commercial|account executive|new business", "Sales"),
    (r"marketing|brand|demand gen|advertis|communications|growth", "Marketing"),
    (r"customer|client|\bcx\b|\bcs\b|support|success|member care|professional services|onboarding", "Customer Success"),
    (r"^(?!.*\b(drug|clinical|pharma|bio\w*)\b).*(quality assurance|\bqa\b|\bsqa\b|\bautomation\b|validation|verification|\bv ?& ?v\b|\bsdet\b)", "QA & Automation"),
    (r"devops|\bsre\b|site reliability|infrastructure|\binfra\b|cloud ?ops|platform ops|production engineering|\bnoc\b", "DevOps & Infrastructure"),
    (r"hardware|embedded|firmware|mechanical|electrical|electronics|silicon|\bvlsi\b|\basic\b|\brf\b|optics|photonics|technicians?", "Hardware & Embedded"),
    (r"\bdata\b|\bai\b|\bml\b|machine learning|analytics|\bbi\b|algorithm|insight|research|intelligence|science", "Data & AI"),
    (r"product manage|^product$|product ops|product operation|product deliver|product solution|product growth|product technology", "Product"),
    (r"design|\bux\b|\bui\b|creative", "Design"),
    (r"\bit\b|information system|helpdesk|service desk|business system|business application", "IT"),
    (r"legal|compliance|audit|regulatory|privacy", "Legal"),
    (r"finance|account(ing|s)?\b|payroll|treasury|\brisk\b|\btax\b|billing|reconciliation", "Finance"),
    (r"people|human resource|\bhr\b|recruit|talent|culture", "HR"),
    (r"manufactur|production|supply chain|logistics|warehouse|quality", "Manufacturing"),
    (r"engineering|\br ?& ?d\b|\brnd\b|software|\bdev\b|development|platform|technolog|\btech\b|architecture|\bcto\b|solutions?\b|programming", "Software Engineering"),
    (r"operations?|\bops\b|delivery|project management|program management|business operations|operational excellence", "Operations"),
]
FAMILY_DEPARTMENT = {
    "backend": "Software Engineering", "frontend": "Software Engineering", "fullstack": "Software Engineering", "mobile": "Software Engineering",
    "data_engineering": "Data & AI", "data_science": "Data & AI", "data_analytics": "Data & AI", "ml_engineering": "Data & AI",
    "ml_infra": "DevOps & Infrastructure", "devops_sre": "DevOps & Infrastructure", "infrastructure_platform": "DevOps & Infrastructure",
    "security_engineering": "Security", "security_research": "Security", "qa_automation": "QA & Automation", "embedded_firmware": "Hardware & Embedded",
    "product": "Product", "design": "Design", "sales": "Sales", "support": "Customer Success", "marketing": "Marketing",
    "finance": "Finance", "hr": "HR", "legal": "Legal", "operations": "Operations",
}

# --- fixed values: page texts
GONE = r"(?i)no open positions|position (is )?(no longer|not) (available|open)|this (job|position|posting) (is )?(no longer|has been) (available|open|filled|closed|removed)|job not found|posting not found|sorry,? (this|that) (job|position|opening)"
BLOCKED = r"(?i)attention required!|just a moment\.\.\.|checking your browser|cf-browser-verification|enable javascript and cookies|access denied|are you a robot|you have been blocked|security check|verify you are human|ddos protection"

# --- fixed values: requirement texts
SECTION_HEADER = r"(?i)\b(requirements|qualifications|what you'?ll need|what you need|you'?ll need|what we're looking for|minimum qualifications|nice to have|nice-to-have|advantages?|bonus(?: points)?|preferred qualifications|preferred|responsibilities|what you'?ll do|what you will do|what you'?ll be doing|what you will be doing|what you'?ll bring|what you bring|you'?ll bring|you bring|who you are|about you|must[\s-]haves?|required skills(?: and experience)?|key (?:requirements|qualifications)|your experience|about the role|the role|role overview|your role)(?:\s*:\s*|\s*(?=(?-i:[A-Z0-9•●‣⁃])))"
NICE_HEADERS = ["nice to have", "nice-to-have", "advantage", "advantages", "bonus", "bonus points", "preferred qualifications", "preferred"]
RESPONSIBILITY_HEADERS = ["responsibilities", "what you'll do", "what youll do", "what you will do", "what you'll be doing", "what youll be doing", "what you will be doing", "about the role", "the role", "role overview", "your role"]
NO_BREAK_AFTER = ["with", "in", "on", "of", "to", "for", "and", "or", "as", "by", "via", "at", "from", "into", "using", "a", "an", "the", "our", "your", "their"]
SOFTENER = r"(?i)\b(advantage|plus|nice to have|preferred|bonus|familiarity with|familiar with|is a plus|ideally|desired|good to have)\b"
HARD_WORD = r"(?i)\b(must|required|require|requires|at least|minimum|min\.|proven|mandatory)\b"
DEGREE = r"(?i)\b(b\.?sc\.?|bachelor'?s?(?:\s+degree)?|m\.?sc\.?|master'?s?(?:\s+degree)?|ph\.?d\.?|doctorate|degree in [a-zA-Z\s]+)\b"
CERTIFICATION = r"(?i)\b([\w]+(?:\s[\w]+){0,3}\s+certifi(?:cation|ed)|certified\s[\w]+(?:\s[\w]+){0,3}|aws certified[\w\s]*|cissp|ccna|ccnp|pmp|ckad|cka|oscp)\b"
LANGUAGE = r"(?i)\b(fluent (?:in )?[a-zA-Z]+|native (?:speaker of )?[a-zA-Z]+|(english|hebrew|spanish|french|german|arabic|mandarin|russian)\s+(?:speaker|proficiency|required|fluency))\b"
LOCATION = r"(?i)\b(on-?site|hybrid|must be (?:located|based) in [\w\s,]+|relocation to [\w\s,]+|based in [\w\s,]+)\b"
YEARS_BULLET = r"(?i)(\d{1,2})\s*\+?\s*years?\s+(?:of\s+)?(?:experience\s+(?:with|in)\s+)?([a-zA-Z][\w\s./#+-]{2,40}?)(?:experience)?[.,;]|(\d{1,2})\s*-\s*\d{1,2}\s*years?\s+(?:of\s+)?(?:experience\s+(?:with|in)\s+)?([a-zA-Z][\w\s./#+-]{2,40}?)[.,;]"
YEARS_TOTAL = [
    r"(?i)(\d{1,2})\s*\+?\s*years?\s+(?:of\s+)?(?:professional\s+|relevant\s+|overall\s+)?experience\b",
    r"(?i)(?:at least|minimum(?:\s+of)?|over)\s*(\d{1,2})\s*years?\s+(?:of\s+)?experience\b",
    r"(?i)(\d{1,2})\s*-\s*\d{1,2}\s*years?\s+(?:of\s+)?experience\b",
]

# --- fixed values: seniority, first match wins, and its level
SENIORITY_TITLES = [("head", r"(?i)\bhead of\b"), ("manager", r"(?i)\b(manager|vp|vice president|cto|director)\b"), ("principal", r"(?i)\bprincipal\b"), ("staff", r"(?i)\bstaff\b"), ("lead", r"(?i)\b(lead|tech lead|team lead)\b"), ("senior", r"(?i)\bsenior\b|\bsr\.?\b"), ("junior", r"(?i)\bjunior\b|\bjr\.?\b|\bentry.level\b|\bgraduate\b")]
SENIORITY_LEVEL = {"junior": 0, "mid": 1, "senior": 2, "lead": 3, "staff": 3, "principal": 4, "manager": 4, "head": 5}

# --- fixed values: scoring
STRENGTH = {"strong": 1.0, "medium": 0.7, "weak": 0.3, "none": 0.0}
WEIGHTS = {"must": 0.50, "seniority": 0.25, "nice": 0.125, "evidence": 0.125}
GATES = {"unmet_hard": 45, "missing_skills": 55, "missing_skills_from": 2, "seniority_gap": 50, "seniority_gap_from": 2}
BANDS = [(85, "strong match"), (70, "good match"), (50, "partial match"), (30, "weak match"), (0, "not a fit")]
FAMILY_FIT = {"gate": 0.3, "cap": 35, "signature_bonus": 10.0, "penalty": 15.0, "adjacent": 0.5, "floor": 0.1, "unknown": 0.5}
DECAY_YEARS, SIGNATURE_IDF, STALE_YEARS, FULL_CONFIDENCE_CHARS = 6.0, 6.0, 3, 50

# --- our own vocabulary of skills and role families (order decides ties)
SKILLS = [(x.split("|")[0], x.split("|")) for x in "python|py3,java,golang|go lang,rust,scala,kotlin,typescript,javascript|js,react,angular,node.js|nodejs,c++|cpp,sql,postgresql|postgres,mysql,mongodb,redis,kafka,spark|pyspark,airflow,hadoop,snowflake,kubernetes|k8s,docker,terraform,ansible,aws|amazon web services,azure,gcp|google cloud,linux,git,jenkins,pytorch,tensorflow,pandas,numpy,machine learning,deep learning,nlp,llm,statistics,tableau,excel,figma,selenium,cypress,embedded,fpga,penetration testing,siem,salesforce,seo,grpc,graphql,rest,microservices".split(",")]
FAMILIES = {
    "backend": ["backend", "back-end", "server side", "software engineer", "software developer"], "frontend": ["frontend", "front-end", "ui developer"], "fullstack": ["fullstack", "full stack", "full-stack"],
    "mobile": ["mobile", "android", "ios"], "data_engineering": ["data engineer", "etl", "data platform"], "data_science": ["data scientist", "data science"], "data_analytics": ["data analyst", "bi developer", "analytics"],
    "ml_engineering": ["ml engineer", "machine learning engineer", "ai engineer"], "ml_infra": ["mlops", "ml infrastructure", "ai infrastructure"], "devops_sre": ["devops", "sre", "site reliability"],
    "infrastructure_platform": ["platform engineer", "infrastructure"], "security_engineering": ["security engineer", "application security"], "security_research": ["security researcher", "malware"], "qa_automation": ["qa", "automation engineer", "test engineer"],
    "embedded_firmware": ["embedded", "firmware"], "product": ["product manager", "product owner"], "design": ["designer", "ux"], "sales": ["sales", "account executive"], "support": ["support engineer", "customer success"],
    "marketing": ["marketing", "content writer"], "finance": ["finance", "accountant"], "hr": ["recruiter", "human resources"], "legal": ["counsel", "legal"], "operations": ["operations", "logistics"], "management": ["team lead", "engineering manager", "director"],
}

# --- fixed values: parts of a listing card that are not its title
CARD_EMPLOYMENT = r"full[\s-]?time|part[\s-]?time|temporary|permanent|contract|freelance"
CARD_MODE = r"remote|hybrid|on[\s-]?site|in[\s-]?office"
CARD_SENIORITY = r"senior|junior|jr\.?|sr\.?|mid[\s-]level|mid|intermediate|entry[\s-]level|associate|experienced|management"
CARD_TRAILING_SENIORITY = r"senior|junior|jr\.?|sr\.?|mid[\s-]level|mid|entry[\s-]level|intermediate"
CARD_CTA = r"apply(\s+(now|today|here))?|(read|learn|view|see)\s+more|view\s+(job|role|position|details)|more\s+details"
CARD_PLACE_LABEL = r"\blocations?\b\s*:?|\boffices?\b\s*:"
GENERIC_CARD = r"apply(\s+(now|today|here|for\s+this\s+(position|job|role)))?|(read|learn|view|see|find\s+out)\s+more|more\s+(details|info(rmation)?)|(view|open|show)\s+(job|role|position|details|page)|job\s+details|open\s+page|tell\s+me\s+more|external\s+post|details|view|register"
PAGE_TITLE_PREFIX = r"(?i)^\s*(job\s+(opportunity|opening|posting|description)|career\s+opportunity|vacancy|position|job|role)\s*[:\-–—]\s*"
WALL_TITLE = r"(?i)you have been blocked|attention required|just a moment|access denied|page not found|404|forbidden|error|security check|verify you are human|are you a robot"

# --- fixed values: places abroad
COUNTRIES = ["israel", "united states", "united states of america", "united kingdom", "england", "scotland", "germany", "france", "spain", "portugal", "italy", "ireland", "netherlands", "belgium", "switzerland", "austria", "poland", "ukraine", "romania", "bulgaria", "hungary", "czech republic", "serbia", "greece", "turkey", "cyprus", "sweden", "denmark", "norway", "finland", "canada", "mexico", "brazil", "argentina", "australia", "new zealand", "india", "china", "japan", "taiwan", "singapore", "south korea", "thailand", "vietnam", "philippines", "united arab emirates", "dubai", "saudi arabia", "south africa", "nigeria", "kenya", "egypt"]
COUNTRY_CODES = r"USA?|U\.S\.A?\.?|UK|UAE"
FOREIGN_CITIES = ["new york", "nyc", "brooklyn", "san francisco", "bay area", "silicon valley", "palo alto", "mountain view", "sunnyvale", "santa clara", "san jose", "los angeles", "san diego", "seattle", "bellevue", "portland", "denver", "boulder", "austin", "dallas", "houston", "atlanta", "miami", "orlando", "chicago", "detroit", "minneapolis", "boston", "philadelphia", "washington,? d\\.?c\\.?", "raleigh", "charlotte", "toronto", "vancouver", "montreal", "ottawa", "mexico city", "sao paulo", "buenos aires", "london", "manchester", "edinburgh", "glasgow", "bristol", "oxford", "dublin", "belfast", "paris", "lyon", "berlin", "munich", "hamburg", "frankfurt", "cologne", "stuttgart", "dusseldorf", "amsterdam", "rotterdam", "brussels", "luxembourg", "zurich", "geneva", "vienna", "copenhagen", "stockholm", "oslo", "helsinki", "madrid", "barcelona", "lisbon", "porto", "milan", "milano", "rome", "roma", "warsaw", "krakow", "prague", "budapest", "bucharest", "sofia", "belgrade", "zagreb", "athens", "istanbul", "kyiv", "kiev", "bangalore", "bengaluru", "hyderabad", "pune", "mumbai", "delhi", "gurgaon", "noida", "chennai", "singapore", "hong kong", "shanghai", "beijing", "shenzhen", "taipei", "seoul", "tokyo", "osaka", "sydney", "melbourne", "brisbane", "auckland", "dubai", "abu dhabi", "riyadh", "doha", "cairo", "nairobi", "johannesburg", "cape town"]
US_STATES = ["AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY"]

# --- fixed values: CV texts
CV_EXPERIENCE_HEADERS = ["experience", "work experience", "employment"]
CV_SKILLS_HEADERS = ["skills", "technical skills", "technologies", "tech stack", "core competencies"]
CV_OTHER_HEADERS = ["education", "certifications", "languages", "summary", "about"]
CV_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t|tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
CV_NOW = r"present|current|now|ongoing"
CV_BULLET = r"^\s*[-*•●‣⁃�]\s+"
CV_JOB_WORD = r"(?i)\b(engineer|engineering|developer|programmer|architect|scientist|researcher|analyst|manager|director|head|lead|chief|officer|president|executive|designer|writer|editor|marketer|recruiter|accountant|controller|counsel|attorney|advisor|consultant|coach|trainer|instructor|specialist|coordinator|administrator|technician|operator|representative|associate|intern|apprentice|founder|owner|sdet|devops|sre|qa|vp|cto|cfo|ceo|coo|ciso)\b"
CV_CITY = r"(?i)\b(tel aviv|jerusalem|haifa|herzliya|ramat gan|petah tikva|netanya|beer sheva|new york|san francisco|london|berlin|austin|seattle|boston|remote)\b"
EVIDENCE_MARKER = r"(?i)\b(\d+%|\$\d[\d,]*|\d+[kmb]\+?|production|owned|designed|led|architected|scaled|launched|shipped|built from scratch|reduced|increased|improved|optimized|delivered|drove|spearheaded)\b"
CV_SENIORITY = [("head", r"(?i)\bhead of\b"), ("manager", r"(?i)\b(manager|vp|vice president|cto)\b"), ("principal", r"(?i)\bprincipal\b"), ("staff", r"(?i)\bstaff\b"), ("lead", r"(?i)\b(lead|tech lead|team lead)\b"), ("senior", r"(?i)\bsenior\b|\bsr\.?\b"), ("junior", r"(?i)\bjunior\b|\bjr\.?\b|\bentry.level\b|\bintern\b")]

# --- fixed values: ranges of the weight search
SEARCH_WEIGHTS = {"must": (0.30, 0.60), "seniority": (0.10, 0.30), "nice": (0.05, 0.20), "evidence": (0.05, 0.20)}
SEARCH_FAMILY_FIT = {"gate": (0.20, 0.40), "cap": (25, 45), "signature_bonus": (0.0, 20.0), "penalty": (0.0, 25.0), "adjacent": (0.40, 0.70)}
