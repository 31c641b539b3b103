"""Fixed values of the domain: word lists, weights and thresholds, in their order of precedence."""

from __future__ import annotations

#: Document types and the phrases that indicate them; the first of equal scores wins.
DOCUMENT_TYPES = {
    "policy": ["politique de sécurité", "security policy", "politique générale", "cette politique", "la présente politique", "policy statement"],
    "procedure": ["procédure", "procedure", "mode opératoire", "instructions", "étapes à suivre", "process steps", "marche à suivre"],
    "standard": ["standard", "norme", "spécifications", "requirements", "exigences techniques", "technical standard"],
    "guideline": ["guide", "guideline", "recommandations", "bonnes pratiques", "best practices", "lignes directrices"],
    "audit_report": ["rapport d'audit", "audit report", "findings", "constatations", "non-conformités", "plan d'action", "corrective actions"],
    "risk_assessment": ["évaluation des risques", "risk assessment", "analyse de risque", "matrice des risques", "risk matrix", "impact analysis"],
    "incident_report": ["rapport d'incident", "incident report", "security incident", "breach report", "violation de sécurité"],
    "faq": ["faq", "questions fréquentes", "frequently asked", "q&a", "questions et réponses", "questions/réponses"],
    "control_matrix": ["matrice de contrôle", "control matrix", "liste des contrôles", "control framework", "cadre de contrôle"],
}

#: The shorter list by which a text is cut into strips.
STRIP_DOCUMENT_TYPES = {
    "policy": ["politique de sécurité", "security policy", "politique générale"],
    "procedure": ["procédure", "procedure", "mode opératoire", "instruction"],
    "audit_report": ["rapport d'audit", "audit report", "compte rendu d'audit"],
    "faq": ["faq", "questions fréquentes", "frequently asked"],
    "control_matrix": ["matrice", "contrôles", "controls matrix", "registre"],
}

FRAMEWORKS = ["ISO 27001", "ISO 27002", "ISO 27701", "SOC 2", "SOC2", "RGPD", "GDPR", "PCI DSS", "PCI-DSS", "HIPAA", "SOX", "NIST", "ANSSI", "RGS", "eIDAS", "NIS", "LPM"]

MANDATORY_WORDS = ["doit", "doivent", "est obligatoire", "sont obligatoires", "il est impératif", "il est requis", "exige", "impose", "shall", "must", "mandatory", "required"]
SEQUENCE_WORDS = ["étape", "step", "phase", "d'abord", "ensuite", "puis", "enfin", "finalement", "premièrement", "deuxièmement", "first", "then", "next", "finally"]
RISK_WORDS = ["risque", "risk", "menace", "threat", "vulnérabilité", "vulnerability", "impact", "probabilité", "probability", "exposition", "exposure"]
CONTROL_TYPES = {
    "technical_controls": ["pare-feu", "firewall", "antivirus", "chiffrement", "encryption", "authentification", "authentication", "mot de passe", "password", "certificat", "certificate", "vpn", "ids", "ips", "siem", "backup", "sauvegarde", "restauration", "recovery"],
    "administrative_controls": ["procédure", "procedure", "processus", "process", "formation", "training", "sensibilisation", "awareness", "audit", "revue", "review", "approbation", "approval", "autorisation"],
    "physical_controls": ["accès physique", "physical access", "badge", "biométrie", "biometric", "surveillance", "camera", "alarme", "alarm", "salle serveur", "data center", "coffre-fort", "safe"],
}
#: (category, weight of a hit, words), in order of precedence.
CATEGORIES = [
    ("policy", 2, MANDATORY_WORDS),
    ("control", 1, CONTROL_TYPES["technical_controls"]),
    ("compliance", 3, [f.lower() for f in FRAMEWORKS]),
    ("procedure", 1, SEQUENCE_WORDS),
    ("risk", 1, RISK_WORDS),
]

OBLIGATIONS = {
    "mandatory": ["doit", "doivent", "obligatoire", "impératif", "must", "shall", "mandatory"],
    "forbidden": ["ne doit pas", "ne doivent pas", "interdit", "prohibition", "must not", "shall not"],
    "recommended": ["devrait", "devraient", "recommandé", "should", "recommended"],
    "optional": ["peut", "peuvent", "optionnel", "may", "can", "optional"],
}
REQUIREMENT_WORDS = ["doit", "doivent", "obligatoire", "requis", "nécessaire", "must", "shall", "required", "mandatory"]
CRITICAL_WORDS = ["critique", "critical", "urgent", "immédiat", "immediate", "obligatoire", "mandatory", "interdit", "forbidden", "prohibited"]
AUTHORITY = {"policy": 1.0, "standard": 0.9, "procedure": 0.8, "guideline": 0.6, "faq": 0.5, "general": 0.3}

#: Audit contexts and the patterns of a question that point to them.
CONTEXT_PATTERNS = {
    "iso_27001": [r"iso\s*27001", "isms", "smsi", "système de management", "management system", "annexe a", "annex a", r"contrôle\s+a\.\d+", "statement of applicability", "soa"],
    "rgpd_gdpr": ["rgpd", "gdpr", r"article\s+\d+\s+rgpd", "données personnelles", "personal data", "privacy", "vie privée", "consentement", "dpo", "data protection officer"],
    "technical_audit": ["configuration", "technique", "technical", "architecture", "infrastructure", "réseau", "firewall", "serveur", "vulnerability", "hardening", "patch", r"cve-\d{4}-\d+"],
    "rfp_response": ["appel d'offre", "rfp", "rfq", "tender", "proposition", "capacité", "référence client", "expérience", "expertise", "différenciateur"],
    "incident_response": ["incident", "crise", "crisis", "breach", "urgence", "emergency", "escalade", "notification", "recovery", "rto", "rpo"],
}
#: (context, required elements, preferred elements, weight by document type, authority required)
AUDIT_RULES = [
    ("iso_27001", ["politique", "procédure", "contrôle", "mesure", "responsabilité", "revue", "amélioration continue"], ["pdca", "plan-do-check-act", "indicateur", "kpi", "audit interne", "revue de direction", "non-conformité"], {"policy": 1.0, "procedure": 0.9, "standard": 0.8, "audit_report": 0.7, "control_matrix": 0.9, "guideline": 0.5, "faq": 0.3}, True),
    ("rgpd_gdpr", ["données personnelles", "personal data", "consentement", "droits", "traitement", "responsable", "sous-traitant", "dpo", "protection", "privacy"], ["minimisation", "portabilité", "effacement", "rectification", "notification", "violation", "impact assessment", "aipd", "base légale", "finalité"], {"policy": 1.0, "procedure": 0.9, "privacy_notice": 1.0, "dpia": 0.95, "register": 0.9, "guideline": 0.6, "faq": 0.4}, True),
    ("technical_audit", ["configuration", "paramètre", "architecture", "sécurité", "vulnérabilité", "patch", "mise à jour", "firewall", "chiffrement", "authentification"], ["hardening", "baseline", "cis", "benchmark", "scan", "pentest", "logs", "monitoring", "siem", "ids", "ips"], {"technical_standard": 1.0, "configuration_guide": 0.95, "architecture_document": 0.9, "procedure": 0.8, "audit_report": 0.85, "incident_report": 0.7, "faq": 0.3}, False),
    ("rfp_response", ["capacité", "expérience", "référence", "certification", "méthodologie", "équipe", "compétence", "sla"], ["cas client", "success story", "retour d'expérience", "innovation", "valeur ajoutée", "différenciateur", "roadmap", "evolution"], {"company_presentation": 0.9, "case_study": 1.0, "certification": 0.95, "policy": 0.7, "methodology": 0.9, "faq": 0.5}, False),
    ("incident_response", ["incident", "crise", "escalade", "notification", "containment", "éradication", "recovery", "leçons"], ["rto", "rpo", "playbook", "runbook", "contact", "communication", "forensics", "timeline", "post-mortem"], {"incident_procedure": 1.0, "crisis_plan": 0.95, "contact_list": 0.9, "incident_report": 0.85, "lessons_learned": 0.8, "policy": 0.6}, True),
]
#: Controls of the first framework and their counterparts in two others.
CONTROL_MAPPING = {
    "A.5": ["AC-1", "AT-1", "AU-1", "CIS 1", "CIS 2"],
    "A.9": ["AC-2", "AC-3", "AC-6", "CIS 5", "CIS 6"],
    "A.12.6": ["RA-5", "SI-2", "CIS 3", "CIS 4"],
    "A.16": ["IR-4", "IR-5", "IR-6"],
}
QUALITY_WEIGHTS = {"has_version": 0.1, "has_date": 0.1, "has_author": 0.1, "has_approver": 0.15, "has_classification": 0.15, "has_references": 0.1, "has_doc_code": 0.2, "has_owner": 0.1}
LIFECYCLE = {
    "draft": ["draft", "brouillon", "ébauche", "version de travail"],
    "review": ["en révision", "under review", "en relecture", "à valider"],
    "approved": ["approuvé", "approved", "validé", "final"],
    "active": ["actif", "active", "en vigueur", "applicable"],
    "obsolete": ["obsolète", "obsolete", "périmé", "deprecated", "remplacé"],
}
SANITY_WORDS = ["le", "la", "les", "de", "et", "est", "the", "and", "is", "of"]
STOP_WORDS = ["le", "la", "les", "un", "une", "des", "de", "du", "?", "!", "."]
QUESTION_WORDS = ["comment", "pourquoi", "quoi", "où", "quand"]
TYPE_SCORES = {"definition": 0.6, "statement": 0.5, "example": 0.4, "enumeration": 0.5}
RELEVANCE = [("highly_relevant", 0.8), ("relevant", 0.65), ("somewhat_relevant", 0.5), ("barely_relevant", 0.3)]
MECHANISM_WORDS = ["mécanisme", "utilise", "permet", "calcule", "traite"]

#: Frameworks and the ways they are written.
FRAMEWORK_VARIANTS = {
    "ISO 27001": ["ISO27001", "ISO 27001", "ISO/IEC 27001", "ISO/CEI 27001"],
    "ISO 27002": ["ISO27002", "ISO 27002", "ISO/IEC 27002"],
    "ISO 27005": ["ISO27005", "ISO 27005", "ISO/IEC 27005"],
    "ISO 27017": ["ISO27017", "ISO 27017", "ISO/IEC 27017"],
    "ISO 27018": ["ISO27018", "ISO 27018", "ISO/IEC 27018"],
    "ISO 27701": ["ISO27701", "ISO 27701", "ISO/IEC 27701"],
    "ISO 22301": ["ISO22301", "ISO 22301", "ISO/IEC 22301"],
    "RGPD": ["RGPD", "GDPR", "Règlement Général sur la Protection des Données"],
    "NIS": ["NIS", "Directive NIS", "Network and Information Security"],
    "NIS2": ["NIS2", "NIS 2", "Directive NIS 2"],
    "LPM": ["LPM", "Loi de Programmation Militaire"],
    "eIDAS": ["eIDAS", "electronic IDentification Authentication and trust Services"],
    "PCI DSS": ["PCI DSS", "PCI-DSS", "Payment Card Industry Data Security Standard"],
    "HIPAA": ["HIPAA", "Health Insurance Portability and Accountability Act"],
    "SOX": ["SOX", "Sarbanes-Oxley", "Sarbanes Oxley"],
    "SOC 2": ["SOC 2", "SOC2", "Service Organization Control 2"],
    "NIST CSF": ["NIST CSF", "NIST Cybersecurity Framework", "NIST Framework"],
    "CIS Controls": ["CIS Controls", "CIS", "Center for Internet Security"],
    "ANSSI": ["ANSSI", "Agence Nationale de la Sécurité des Systèmes d'Information"],
    "RGS": ["RGS", "Référentiel Général de Sécurité"],
    "EBIOS": ["EBIOS", "EBIOS Risk Manager", "EBIOS RM"],
}
SECURITY_DOMAINS = {
    "Gestion des accès": ["gestion des accès", "access management", "IAM", "authentification", "authentication", "autorisation", "authorization", "privilèges", "privileges", "RBAC", "contrôle d'accès", "access control", "SSO", "MFA", "2FA"],
    "Sécurité réseau": ["sécurité réseau", "network security", "pare-feu", "firewall", "IDS", "IPS", "DMZ", "segmentation", "VPN", "NAC", "proxy", "WAF"],
    "Cryptographie": ["cryptographie", "cryptography", "chiffrement", "encryption", "PKI", "certificat", "certificate", "TLS", "SSL", "AES", "RSA", "hash", "signature"],
    "Sécurité des données": ["sécurité des données", "data security", "classification", "DLP", "Data Loss Prevention", "pseudonymisation", "anonymisation", "minimisation", "retention"],
    "Continuité": ["continuité", "continuity", "PCA", "PRA", "DRP", "Business Continuity", "Disaster Recovery", "RTO", "RPO", "sauvegarde", "backup", "restauration", "recovery"],
    "Gestion des incidents": ["incident", "SIEM", "SOC", "CERT", "CSIRT", "forensics", "investigation", "réponse", "response", "escalade", "escalation", "crise", "crisis"],
    "Gouvernance": ["gouvernance", "governance", "politique", "policy", "procédure", "procedure", "RACI", "comité", "committee", "risque", "risk", "conformité", "compliance"],
    "Sécurité physique": ["sécurité physique", "physical security", "badge", "biométrie", "biometric", "surveillance", "CCTV", "contrôle d'accès physique", "datacenter"],
}
RISK_LEVELS = {
    "Critique": ["critique", "critical", "très élevé", "very high", "P1", "sévérité 1"],
    "Élevé": ["élevé", "high", "important", "majeur", "major", "P2", "sévérité 2"],
    "Moyen": ["moyen", "medium", "modéré", "moderate", "P3", "sévérité 3"],
    "Faible": ["faible", "low", "mineur", "minor", "P4", "sévérité 4"],
    "Négligeable": ["négligeable", "negligible", "très faible", "very low"],
}
SECURITY_ROLES = {
    "RSSI": ["RSSI", "CISO", "Chief Information Security Officer", "Responsable de la Sécurité des Systèmes d'Information"],
    "DPO": ["DPO", "Data Protection Officer", "Délégué à la Protection des Données"],
    "DSI": ["DSI", "CIO", "Chief Information Officer", "Directeur des Systèmes d'Information"],
    "Administrateur": ["administrateur", "admin", "sysadmin", "administrator"],
    "Auditeur": ["auditeur", "auditor", "auditeur interne", "auditeur externe"],
    "SOC Analyst": ["analyste SOC", "SOC analyst", "opérateur SOC"],
    "Architect": ["architecte sécurité", "security architect", "architecte SI"],
}
SECURITY_DOCUMENT_TYPES = {
    "security_policy": ["politique de sécurité", "security policy", "pssi"],
    "security_procedure": ["procédure de sécurité", "security procedure", "mode opératoire"],
    "risk_assessment": ["analyse de risque", "risk assessment", "ebios"],
    "audit_report": ["rapport d'audit", "audit report", "compte-rendu d'audit"],
    "incident_report": ["rapport d'incident", "incident report", "fiche d'incident"],
    "compliance_matrix": ["matrice de conformité", "compliance matrix", "référentiel"],
    "security_standard": ["standard de sécurité", "security standard", "norme"],
    "security_guideline": ["guide de sécurité", "security guideline", "recommandations"],
}
SECURITY_KEYWORDS = ["sécurité", "security", "authentification", "authentication", "chiffrement", "encryption", "mot de passe", "password", "vulnérabilité", "vulnerability", "risque", "risk", "conformité", "compliance", "audit", "iso", "rgpd", "gdpr"]
TOPICS = {
    "authentification": ["authentification", "authentication", "login", "connexion", "2fa", "mfa"],
    "mots_de_passe": ["mot de passe", "password", "mdp", "credential"],
    "chiffrement": ["chiffrement", "encryption", "cryptage", "aes", "rsa"],
    "conformité": ["conformité", "compliance", "rgpd", "gdpr", "iso", "audit"],
    "incident": ["incident", "breach", "violation", "compromission"],
    "sauvegarde": ["sauvegarde", "backup", "restauration", "recovery"],
    "réseau": ["réseau", "network", "firewall", "pare-feu", "vpn"],
    "accès": ["accès", "access", "permission", "autorisation", "privilège"],
}
SHEET_HEADERS = {
    "control_matrix": r"contr[ôo]le|control|mesure|measure|exigence|requirement|r[éè]f[ée]rence|reference|statut|status|[ée]tat|state|responsable|owner|criticité|criticality|conforme|compliant|conformit[ée]|compliance",
    "risk_register": r"risque|risk|menace|threat|impact|probabilit[ée]|probability|niveau|level|score|mitigation|traitement|treatment",
    "inventory": r"actif|asset|nom|name|type|cat[ée]gorie|category|propri[ée]taire|owner|localisation|location|version|criticité|criticality",
}
STATUS = {
    "compliant": "conforme|ok|compliant|pass|vert|green",
    "non_compliant": "non.?conforme|nok|ko|fail|rouge|red",
    "partial": "partiel|partial|orange|jaune|yellow",
    "na": "n/?a|non.?applicable|not.?applicable",
}
QUESTION_INTENTS = {
    "comment_fonctionne": ["comment.*fonctionne", "comment.*marche", "comment.*(?:fait|font)", "comment.*utilise"],
    "qu_est_ce_que": ["qu'est[- ]ce", "c'est quoi", "définition", "que sont"],
    "pourquoi": ["pourquoi", "quelle.*raison", "quel.*but"],
}
