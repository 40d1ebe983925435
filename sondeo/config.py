"""Fixed values that must equal the original analyses for results to match.

Everything in this module is data, stated in natural order: label vocabularies,
keyword dictionaries, refusal codes, item names and reverse-keyed items.
"""

# --- fixed values: 4-point agreement vocabulary, code 1..4 in this order ---
LIKERT_LABELS = [
    "Totalmente en desacuerdo",
    "En desacuerdo",
    "De acuerdo",
    "Totalmente de acuerdo",
]

# --- fixed values: two 4-point vocabularies sharing codes (code: labels) ---
SIMILARITY_FREQUENCY_LABELS = {
    4: ["Muy parecido a mí", "Siempre/Casi siempre"],
    3: ["Parecido a mí", "Muchas veces"],
    2: ["Poco parecido a mí", "Pocas veces"],
    1: ["Nada parecido a mí", "Nunca/Casi nunca"],
}

# --- fixed values: refusal answers that become missing ---
NA_PATTERN = ["Prefiero no contestar", "No contestó"]

# --- fixed values: alumni Likert item names (export positions 39..46) ---
ALUMNI_LIKERT_ITEMS = [
    "l1_motivacion_estudiar",
    "l2_seguridad_decisiones",
    "l3_habilidades_retos",
    "l4_red_apoyo",
    "l5_obstaculos_superados",
    "l6_vision_proyecto_vida",
    "l7_integracion_espacios",
    "l8_responsabilidades_comunidad",
]

# --- fixed values: occupational statuses that count as "still studying" ---
STUDYING_STATUSES = ["Estudiando", "Estudiando y trabajando"]

# --- fixed values: keyword dictionaries for open-text coding ---
# group -> category -> keywords (joined into one case-folded alternation)
TEXT_CATEGORIES = {
    "val": {
        "Amistades/Relaciones": ["amig", "amistad", "compañer", "personas", "convivencia", "convivir"],
        "Mentitos/Mentoría": ["mentito", "mentoria", "mentoría"],
        "habilidades sociales": ["habilidad", "social", "comunicación", "expresar"],
        "Liderazgo": ["líder", "liderazgo", "responsabilidad"],
        "Aprendizajes": ["aprender", "enseñanza", "aprendizaje"],
        "Experiencia general": ["experiencia", "tiempo", "momentos", "todo"],
    },
    "skill": {
        "Liderazgo": ["liderazgo", "líder", "liderar"],
        "Comunicación": ["comunicación", "hablar", "expresar"],
        "Trabajo en equipo": ["equipo", "trabajo en equipo"],
        "Responsabilidad": ["responsabilidad", "responsable"],
        "Empatía": ["empatía", "empatia", "comprensión"],
    },
}

# --- fixed values: personal-data columns removed from exports ---
PERSONAL_COLUMNS = [
    "respondent_id",
    "collector_id",
    "date_created",
    "date_modified",
    "ip_address",
    "email_address",
    "municipio_donde_vives",
    "colonia_donde_vives_solo_aplica_a_nl",
    "celular_10_digitos",
    "correo_electronico",
    "curp_si_no_lo_conoces_lo_puedes_obtener_en_https_www_gob_mx_curp",
    "custom_1",
]
PERSON_NAME_COLUMNS = ["nombre", "nombre_s", "apellido_paterno", "apellido_materno"]

# --- fixed values: mentor scales (name, number of items) ---
MENTOR_SCALES = [("agencia", 10), ("equipo", 9), ("liderazgo", 7), ("empatia", 5), ("decision", 9)]
MENTOR_REVERSED_ITEMS = [
    "equipo_1",
    "equipo_9",
    "empatia_2",
    "empatia_3",
    "empatia_4",
    "decision_6",
    "decision_7",
    "decision_8",
    "decision_9",
]

# --- fixed values: attrition skills, education and state codes (ordered reference levels) ---
SKILLS = ["liderazgo", "empatia", "decision", "equipo"]
EDUCATION_CODES = {
    "Secundaria": "0_Sec",
    "Bachillerato o Preparatoria": "1_Bac",
    "Licenciatura o Universidad": "2_Lic",
    "Maestría": "3_Mae",
    "Doctorado": "4_Doc",
}
STATE_CODES = {
    "Nuevo León": "0_NL",
    "Chihuahua": "1_CH",
    "Tamaulipas": "2_TM",
    "Estado de México": "3_MX",
}

# --- fixed values: free-text municipality -> canonical name, first match wins ---
MUNICIPALITY_PATTERNS = [
    ("victoria", "Cd. Victoria"),
    ("santa", "Santa Catarina"),
    ("ecatepec|presa", "Ecatepec"),
    ("garc(i|í)a", "García"),
    ("fama", "Fama"),
    ("chihuahua", "Chihuahua"),
]

# --- fixed values: age bins (right-closed) and the reference date for age ---
AGE_BREAKS = [0, 11, 12, 13, 14, 15, 16, 99]
AGE_REFERENCE_DATE = "2023-06-06"

# --- fixed values: groupings of the alumni report, label -> key columns ("General" is the whole table) ---
REPORT_GROUPINGS: dict[str, list[str]] = {
    "General": [],
    "Estado": ["estado"],
    "Género": ["sexo"],
    "Estado y género": ["estado", "sexo"],
    "Generación": ["periodo"],
}
