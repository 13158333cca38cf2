"""Default word lists of the name gate and of the universal rewrite. All are parameters elsewhere."""

from __future__ import annotations

# Words that the strict gate never takes for a name.
GATE_NON_NAMES = (
    "Ang", "Ng", "Mga", "Ito", "Iyon", "Iyan", "Hindi", "Oo", "Sige", "Pero", "Subalit", "Ngunit", "Datapwat", "Kahit", "Kapag", "Kung",
    "Walang", "May", "Mayroon", "Wala", "Marami", "Maraming", "Sa", "Para", "Mula", "Hanggang", "Bago", "Pagkatapos", "Ako", "Ikaw", "Siya",
    "Kami", "Tayo", "Sila", "Niya", "Nila", "The", "This", "That", "These", "Those", "It", "He", "She", "They", "Today", "Tomorrow", "Yesterday",
    "Tonight", "Now", "Then", "Breaking", "Update", "Report", "News", "Statement", "Balita", "Ulat", "Trending", "Viral", "Babala", "Paalala",
    "Tingnan", "Pansinin", "Importante", "Kahapon", "Ngayon", "Election", "Campaign", "Survey", "Debate", "Result", "Results", "Official",
    "Department", "Office", "Council", "Senate", "Congress", "Committee", "Court", "Commission", "Bureau", "Agency", "Philippines", "Pilipinas",
    "Manila", "Maynila", "Cebu", "Davao", "Quezon", "Makati", "Pampanga", "Bulacan", "Laguna", "Batangas", "Cavite", "Pangasinan", "Iloilo",
    "Bacolod", "Cagayan", "Zamboanga", "Rizal", "Tagum", "Baguio", "Tarlac", "Bicol", "Visayas", "Mindanao", "Luzon", "Antipolo", "Pasig",
    "Mandaluyong", "Marikina", "Caloocan", "Taguig", "Paranaque", "Las Pinas", "Muntinlupa", "Pasay", "Valenzuela", "Malabon", "Navotas", "Lunes",
    "Martes", "Miyerkules", "Huwebes", "Biyernes", "Sabado", "Linggo", "Mabilis", "Enero", "Pebrero", "Marso", "Abril", "Mayo", "Hunyo", "Hulyo",
    "Agosto", "Setyembre", "Oktubre", "Nobyembre", "Disyembre", "January", "February", "March", "April", "June", "July", "August", "September",
    "October", "November", "December", "Facebook", "Twitter", "YouTube", "TikTok", "Instagram", "WhatsApp", "Viber", "Telegram", "Messenger",
    "Line", "WeChat", "Filipino", "Pilipino", "Tagalog", "English", "American", "Christian", "Muslim", "Catholic", "Atty", "Hon", "Dr", "Mr", "Mrs",
    "Ms", "Sen", "Rep", "Cong", "Gov", "VP", "Sec", "Engr", "Prof", "Senado", "Kongreso", "Korte", "Komisyon", "Kagawaran", "Tanggapan", "Lungsod",
    "Bayan", "Probinsya", "Lalawigan", "Munisipalidad", "Barangay", "Kapitolyo", "Malacañang", "Malacanang", "Candidate",
)
# Organisations and generic references that the strict gate allows.
ORGANISATIONS = (
    "vera files", "rappler", "pcij", "philippine star", "philstar", "abs-cbn", "gma news", "inquirer", "philippine news agency", "pna",
    "philippine daily inquirer", "comelec", "namfrel", "lente", "international fact-checking network", "ifcn", "pulse asia",
    "social weather stations", "sws", "stratbase", "quezon city", "cebu city", "davao city", "manila city", "makati city", "pasig city",
    "taguig city", "paranaque city", "las pinas city", "muntinlupa city", "caloocan city", "san juan city", "valenzuela city", "marikina city",
    "mandaluyong city", "malabon city", "navotas city", "bacolod city", "iloilo city", "zamboanga city", "cagayan de oro", "general santos",
    "metro manila", "pilipinas truth watch", "truth-bureau", "city election bulletin", "party a", "party b", "party c", "supreme court",
    "court of appeals", "sandiganbayan", "ombudsman", "department of justice", "doj", "department of education", "deped", "the deped",
    "department of health", "doh", "department of foreign affairs", "dfa", "department of interior and local government", "dilg",
    "department of national defense", "dnd", "department of finance", "dof", "department of trade and industry", "dti",
    "department of public works and highways", "dpwh", "department of transportation", "dotr", "department of agriculture", "da",
    "armed forces of the philippines", "afp", "philippine national police", "pnp", "presidential communications operations office", "pcoo",
    "presidential communications office", "pco", "national bureau of investigation", "nbi",
    "national disaster risk reduction and management council", "ndrrmc", "national economic and development authority", "neda",
    "bureau of internal revenue", "bir", "philippine institute", "philippine institute for development studies", "police regional office",
    "regional trial court", "rtc", "capital metro area", "capital metro area council", "island group", "china sea", "west philippine sea",
    "barangay sta", "barangay sto", "barangay san", "antipolo city", "tuguegarao city", "olongapo city", "tagaytay city", "tarlac city",
    "san fernando city", "city hall", "city hospital", "daily news", "evening news", "morning news", "justice", "papa", "china",
    "deped candidate", "dilg candidate", "doj candidate", "doh candidate", "doj official", "deped official", "comelec official",
    "philippine institute of volcanology and seismology", "phivolcs",
    "philippine atmospheric geophysical and astronomical services administration", "pagasa", "the president", "president", "the senator",
    "senator", "the mayor", "the governor", "the secretary", "secretary", "police district", "police station", "police force", "chief gen",
    "chief general", "general", "the general", "politiko hindi", "politiko", "the politician", "politician", "the cabinet", "cabinet",
    "the senate", "the congress", "congressman", "congresswoman", "presidente", "presidential", "education sec", "education secretary",
    "the education sec", "intelligence group", "pnp intelligence group", "intelligence service", "investigation group",
    "investigation division", "unang balita", "24 oras", "tv patrol", "saksi", "isang pinay", "pinay", "pinoy", "isang pinoy", "japanese",
    "the japan", "japan", "indonesia", "indonesian", "korean", "the korea", "korea", "chinese vlogger", "japanese vlogger", "election board",
    "election commission", "the election board", "national bureau", "the national bureau", "cybercrime division", "cybercrime unit",
    "the cybercrime division", "valentine's day", "valentines day", "christmas", "holy week",
)

# Tokens of the canonical candidates, where no configuration names others.
CANONICAL_TOKENS = (
    "Sen", "Sen.", "Senator", "Reynaldo", "Rey", "Marquez", "Vice-Mayor", "Vice", "Mayor", "Iris", "Bantayan", "Rep", "Rep.", "Representative",
    "Datu", "Jomar", "JM", "Salonga",
)
# Words that begin sentences.
SENTENCE_STARTS = (
    "Isang", "Sinabi", "Matapos", "Pero", "May", "Kinilala", "Dahil", "Kung", "Kaya", "Para", "Magugunitang", "Isa", "Tila", "Wala", "Base",
    "Ilang", "Aniya", "Magugunita", "Habang", "Hinamon", "Nangako", "Hindi", "Ito", "Ang", "Ngayon", "Ayon", "Ngunit", "Subalit", "At", "Lalong",
    "Lahat", "Kabilang", "Tungkol", "Hanggang", "Update", "Breaking", "Trending", "Babala", "Paalala", "Balita", "Ulat", "Source", "Iniulat",
    "Iyon", "Iyong", "Sino", "Saan", "Mayroon", "Naging", "Bukod", "Bagaman", "Bagkus", "Nasaan", "Bahala", "Maging", "Magkakaiba", "Lalo",
    "Pumasok", "Naayos", "Pinagsama", "Kahapon", "Kahit", "Mas", "Higit", "Sigurado", "Bisitahin", "Magpapatupad", "Dapat", "Maaari", "Naayon",
    "Magtatapos", "Sasama", "Nakatakda", "Tatlong", "Apat", "Lima", "Anim", "Walong", "Sampu", "Halos", "Patuloy", "Pumarating", "Tumahimik",
    "Inaasahan", "Tinukoy", "Sumagot", "Sumagi", "Tunay", "Buong", "Iniwan", "Nilinaw", "Iginiit", "Pinagtibay", "Niyyahura", "Bumagsa",
    "Kumakalat", "Lumalabas", "Ipinagmalaki", "Inilabas", "Idinaos", "Nag", "Naglabas", "Sumusuporta", "Nagsasalita", "Naganap", "Lumitaw",
    "Naaresto", "Tingnan", "Bumaba", "Tumaas", "Nakatanggap", "Sinasakyan", "Nasaktan", "Nahuli", "Nakuha", "Nakaranas", "Pinatunayan", "Bumukas",
    "Ipinagbawal", "Sumailalim", "Bumagsak", "Nagsanib", "Nakatutok", "Sumusunod", "Magbibigay", "Inanunsyo", "Inilathala", "Tumutugon",
    "Sasalubungin", "Idinikit", "Pinasalamatan", "Pumiyok", "Pumiyaok", "Walang", "Lumalakas", "Umabot", "Sangkot", "Sila", "Saklaw", "Maaaring",
    "Nasa", "Tumukoy", "Kakailanganin", "Ipinost", "Ipinakita", "Tanging", "Iboto", "Kumalat", "Sambahan", "Tutugunin", "Antabayanan",
    "Naninindigan", "Kalaban", "Nakikita", "Nilalabanan", "Pinagsabihan", "Magpapakain", "Pinapakain", "Pinakialam", "Hihintayin",
)
# English function words.
FUNCTION_WORDS = (
    "We", "It", "But", "And", "No", "There", "So", "The", "A", "An", "Of", "In", "On", "At", "For", "With", "By", "As", "Is", "Are", "Was", "Were",
    "Will", "Be", "Have", "Has", "Had", "You", "They", "He", "She", "I", "My", "Your", "Our", "Their", "This", "That", "These", "Those", "When",
    "Where", "Why", "How", "Who", "What", "Some", "Any", "Many", "Most", "Few", "Each", "Every", "All", "After", "Before", "During", "Since",
    "Until", "While", "Though", "Although", "Because",
)
# Common words that are no names.
COMMON_WORDS = (
    "Pinoy", "Pinay", "Filipino", "Pilipino", "Pilipinas", "Philippines", "Tagalog", "Pampanga", "Pangulo", "Presidente", "News", "Elections",
    "Election", "Marso", "Mayo", "Hunyo", "Hulyo", "Agosto", "Setyembre", "Oktubre", "Nobyembre", "Disyembre", "Enero", "Pebrero", "Abril", "Bgy",
    "Brgy", "Sec", "Inc", "Corp", "Department", "University", "Foundation", "Christmas", "Pasko", "Vice", "Diyos", "Muslim", "Year", "Bill",
    "Live", "Branch", "Daily", "Valentine", "Bulletin", "Senado", "Palasyo", "Asya", "Asia", "Amerika", "Amerikano", "China", "Indonesia",
    "Thailand", "Korean", "Chinese", "Japanese", "American", "Asian", "Volcanology", "Seismology", "Transportation", "Polytechnic", "Sunday",
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Lunes", "Martes", "Miyerkules", "Huwebes", "Biyernes", "Sabado",
    "Linggo", "Gabinete", "Pangkalahatan", "Pangkalahatang", "Pamayanan", "Lipunan", "Komunidad", "Education", "Board", "Interior", "Inquirer",
    "Ateneo", "Atenean", "Pinasa", "Inihahain", "Iniulat", "Inaalala", "Iniisip", "Hinaharap", "Hinihintay", "Sinusubaybayan", "Inihayag",
    "Ipinakilala", "Iginalang", "Iniaalala", "Yolanda", "Maute", "Ruby", "Lanao", "Rosario", "Metro", "Statement", "Commissioner", "Commissioners",
    "Pangasinan", "Cubao", "Maynila", "Special", "Action", "Force", "First", "Second", "Third", "Fourth", "Fifth", "Annex", "Appendix", "Article",
    "Section", "Senate", "House", "Lower", "Upper", "Chamber",
)
# Places, which stay.
PLACES = (
    "Metro Manila", "Maynila", "Malacanang", "Quezon", "Cebu", "Davao", "Mindanao", "Luzon", "Visayas", "Manila", "Pasay", "Makati", "Taguig",
    "Pasig", "Mandaluyong", "Caloocan", "Pampanga", "Bulacan", "Tarlac", "Cavite", "Laguna", "Batangas", "Rizal", "Bicol", "Marawi",
    "Maguindanao", "Mamasapano", "Magindanao", "Tondo", "Burol", "Lapu", "Lapu City", "Japan", "Tagaytay", "Baguio", "Dagupan", "Antipolo",
    "Iloilo", "Bacolod", "Naga", "Tacloban", "Zamboanga", "Cagayan", "General Santos", "San Juan", "City", "NCR", "CALABARZON", "Region",
    "Province", "Pope", "Papa", "Holy", "Father", "Marikina", "Paranaque", "Tuguegarao", "Taytay", "Olongapo", "Lucena", "Malabon", "Porac",
    "Malate", "Boracay", "Riyadh", "Jeddah", "Canada", "Pasadena", "Angeles", "Bangkal", "Calinan", "San", "Vicente", "Sto", "Sta", "Cruz",
    "Dumalneg", "Capiz", "Aklan", "Bohol", "Negros", "Samar", "Leyte", "Catanduanes", "Sorsogon", "Albay", "Cotabato", "Sulu", "Basilan",
    "Tawi-Tawi", "Palawan", "Masbate", "Romblon", "Mindoro", "Marinduque", "Tagum", "Santos", "General",
)
# Institutions, which stay.
INSTITUTIONS = (
    "DepEd", "PNP", "AFP", "PNP-SAF", "Comelec", "COMELEC", "Senate", "Congress", "Commission", "BBM", "OFW", "CCTV", "GMA", "ABS", "CBN", "INQ",
    "NBI", "PDEA", "WHO", "IATF", "NEDA", "BIR", "DTI", "DSWD", "DPWH", "DOJ", "DOE", "DOH", "DA", "DBM", "DENR", "DOLE", "DOST", "OWWA", "BSP",
    "PSALM", "NPC", "Meralco", "Facebook", "Twitter", "Instagram", "YouTube", "TikTok", "Telegram", "Viber", "Messenger", "Reuters", "AP", "BBC",
    "Inc", "Corp", "Foundation", "University", "Hospital", "Department", "Bureau", "Office", "Court", "House", "Sandiganbayan", "Ombudsman",
    "Constitution", "Supreme", "President", "Presidential", "Holy", "Cybercrime", "Division", "Communications", "Operations", "Regional", "Trial",
    "Police", "Station", "District", "Pulse", "Asia", "SWS", "Stations", "Pulse Asia", "Bangko", "Sentral", "Pilipinas", "Bangko Sentral",
    "Philippine", "Statistics", "Authority", "Philippine Statistics", "Martial", "Law", "Elections", "Education", "Health", "Finance", "Justice",
    "Science", "Technology", "Foreign", "Affairs", "Internal", "Revenue", "Customs", "Immigration", "National", "Investigation", "Defense",
    "Securities", "Exchange", "PCOO", "PIA", "PSA", "PSC", "PCSO", "DICT", "GSIS", "SSS", "PhilHealth", "DFA", "DND", "DAR", "DOTr", "Barangay",
    "Brgy", "Bgy", "Capitol", "Hall", "City", "Province", "Region", "Capital", "Institute", "School", "Academy", "Training", "Group", "Center",
    "Council", "Movement", "Party", "Coalition", "Alliance", "Quezon", "Marian", "Korean", "Chinese", "Japanese", "American", "Filipino", "Asian",
)
