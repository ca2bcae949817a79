"""Word lists and rules that results depend on."""

# Words left out of snippet scoring.
SNIPPET_STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "from", "by", "as", "is", "are", "was", "were", "be", "been", "being",
    "that", "this", "these", "those", "it", "its", "you", "your", "do", "not", "only", "list", "cite", "citations", "excerpts", "excerpt", "quote", "paraphrase",
    "bullet", "bullets", "extraits", "extrait", "uniquement", "des", "les",
]
# Substrings that raise a sentence's score.
PRIORITY_TERMS = [
    "pouvoirs", "exceptionnels", "exceptionnel", "mesures", "exigees", "dissoute", "dissolution", "report", "reporter", "prorog", "election", "president",
    "presidentielle", "scrutin", "conseil", "constitutionnel", "urgence", "emergency",
]
# Terms that the legal rules test for.
PRESIDENT = ["president", "presidente", "presidentielle"]
ABSTRACT_INTENT = ["obligations", "obligation", "devoirs", "devoir", "role", "fonction", "pouvoirs", "pouvoir", "garant", "competences", "competence", "mission", "responsabilites", "responsabilite"]
ELECTION = ["election", "scrutin", "suffrage", "candidat", "mandat", "report", "prorogation"]
EMERGENCY = ["urgence", "urgent", "emergency", "exceptionnel", "exceptionnelle", "exceptionnels", "exceptionnelles", "crise", "menace", "grave", "immediat", "immediate"]
INSTITUTIONS = ["president", "parlement", "gouvernement", "senat", "depute", "ministre", "conseil", "constitutionnel"]
RERANK_ELECTION = ["election", "presidentielle", "scrutin", "report", "prorogation", "candidat", "suffrage"]
RERANK_ABSTRACT = ["obligations", "obligation", "devoirs", "devoir", "role", "fonction", "garant", "mission"]
# Query terms, the articles they favour, and the bonus.
AFFINITIES = [
    (["pleins", "pouvoirs", "exceptionnelles", "exceptionnel", "urgence", "mesures"], ["16"], 0.35),
    (["election", "presidentielle", "scrutin", "report", "prorogation", "candidat"], ["7"], 0.35),
    (["dissolution", "elections", "generales"], ["12"], 0.35),
    (["veille", "continuite", "respect", "constitution", "arbitrage"], ["5"], 0.35),
    (["referendum", "organisation", "pouvoirs", "publics"], ["11"], 0.35),
    (["republique", "indivisible", "democratique"], ["1", "2"], 0.20),
    (["obligations", "obligation", "devoirs", "devoir", "role", "fonction", "garant", "mission"], ["5"], 0.45),
]
# Suffixes of query variants, by the rule that adds them.
EXPANSIONS = {
    "article_one": "article premier republique indivisible laicite democratique sociale",
    "president_role": "article 5 veille constitution arbitrage continuite garant independance traites",
    "president_election": "article 7 election presidentielle scrutin organisation",
    "emergency": "article 16 pouvoirs exceptionnels mesures exigees institutions republique continuite dissoute",
    "emergency_election": "article 7 report election presidentielle conseil constitutionnel scrutin",
    "parliament": "article 24 parlement loi controle gouvernement",
    "government": "article 20 gouvernement responsable devant parlement",
}
# Letters and what they fold to.
ACCENTS, FOLDED = "àâäáãåçéèêëîïíôöóõùûüúœ", "aaaaaaceeeeiiioooouuuuo"
# Function words that mark a French query, and its letters.
FRENCH_WORDS, FRENCH_LETTERS = ["comment", "quoi", "pourquoi", "une", "les", "des", "est"], "àâäéèêëïîôùûüçœ"
# Marks of neighbour context inside a chunk's text.
CONTEXT_BEFORE, CONTEXT_AFTER = "[Contexte précédent]", "[Contexte suivant]"
# Reminders put after the excerpts of articles 16 and 7.
CHECK_HEAD = "\nRappel pour la partie (2) :\n"
CHECK_16 = "- Article 16 : énoncer explicitement que l'Assemblée nationale ne peut être dissoute pendant les pouvoirs exceptionnels, avec citation [n].\n"
CHECK_7 = "- Article 7 : énoncer les règles d'organisation ou de report du scrutin présidentiel pertinentes, avec citation [n].\n"
# Phrases that mark an answer as a refusal.
REFUSALS = ["no information", "aucune information", "do not contain", "ne contiennent pas"]
#: Instructions for answers, by language.
SYSTEM_PROMPTS = {
    "en": "Answer from the numbered excerpts only and cite each claim as [n]. Name an article where its excerpt does. Keep different articles apart, one subsection each. Say which excerpts are off topic and what they leave open. Use no other knowledge.",
    "fr": "Réponds uniquement à partir des extraits numérotés et cite chaque affirmation par [n]. Nomme l'article quand l'extrait le donne. Traite les articles distincts en sous-sections séparées. Dis quels extraits sont hors sujet et ce qu'ils ne couvrent pas. N'utilise aucune autre connaissance.",
}
# BM25 and its field boosts.
K1, B = 1.2, 0.75
BOOSTS = {"text": 1.0, "title": 2.0, "doc_title": 2.5, "section": 1.5, "article": 3.0}
RRF_K = 60
