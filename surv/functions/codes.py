"""Fixed values that must equal the source system's code book.

These are data, not logic: code sets, labels and band limits exactly as the
notification system and the dashboard define them.
"""

# ---- fixed values: classification codes -----------------------------------
CONFIRMED_CODES = ("1", "3", "4", "5", "6", "10", "11", "12")
DISCARDED_CODES = ("2",)
INCONCLUSIVE_CODES = ("8",)
# under investigation as the monthly aggregate table counts it
INVESTIGATION_CODES = ("0", "8", "9", "NI")

CLASS_GROUP_CONFIRMED = "Confirmados"
CLASS_GROUP_DISCARDED = "Descartados"
CLASS_GROUP_INCONCLUSIVE = "Inconclusivos"
CLASS_GROUP_INVESTIGATION = "Em investigação"

# ---- fixed values: outcome codes -------------------------------------------
DEATH_CODES_PROFILE = ("2", "3", "4")
DEATH_CODES_CARDS = ("2",)
DEATH_TEXT = "OBITO"

# ---- fixed values: sentinels ------------------------------------------------
NI = "NI"
PLACE_NOT_INFORMED_VIEW = "Municipio nao informado"
PLACE_NOT_INFORMED_LOADER = "Município não informado"
PLACE_NOT_INFORMED_CONFORM = "NAO INFORMADO"
NOT_INFORMED_LABEL = "Não informado"
UNIT_NOT_IDENTIFIED = "Unidade não identificada"
OTHERS_LABEL = "Outros"

# ---- fixed values: focus scope ---------------------------------------------
FOCUS_STATE_CODES = ("RJ", "33")
FOCUS_STATE_NAME = "RIO DE JANEIRO"

# ---- fixed values: age bands (label, lower, upper inclusive; None = open) --
AGE_BANDS = (
    ("0 a 9", None, 9),
    ("10 a 19", 10, 19),
    ("20 a 39", 20, 39),
    ("40 a 59", 40, 59),
    ("60+", 60, None),
)
AGE_BAND_ORDER = ("0 a 9", "10 a 19", "20 a 39", "40 a 59", "60+", "Não informado")
AGE_BAND_MIDPOINT = {"0 a 9": 5, "10 a 19": 15, "20 a 39": 30, "40 a 59": 50, "60+": 70}

# ---- fixed values: profile-field validity sets -----------------------------
PREGNANCY_VALID = ("1", "2", "3", "4")
RACE_VALID = ("1", "2", "3", "4", "5")
SCHOOL_VALID = ("1", "01", "2", "02", "3", "03", "4", "04", "5", "05", "6", "06",
                "7", "07", "8", "08")

# ---- fixed values: yes answers ---------------------------------------------
YES_CODE = ("1",)
YES_SYMPTOM = ("1", "S", "SIM")

# ---- fixed values: decode tables -------------------------------------------
CLASSIFICATION_LABELS = {
    "0": "Ignorado/Branco",
    "1": "Dengue",
    "2": "Descartado",
    "3": "Dengue com complicacoes",
    "4": "Febre Hemorragica da Dengue",
    "5": "Dengue classico",
    "6": "Sindrome do Choque da Dengue",
    "8": "Inconclusivo",
    "10": "Dengue",
    "11": "Dengue com sinais de alarme",
    "12": "Dengue grave",
}
OUTCOME_LABELS = {
    "0": "Ignorado/Branco",
    "1": "Cura",
    "2": "Obito pelo agravo",
    "3": "Obito por outras causas",
    "4": "Obito em investigacao",
    "9": "Ignorado",
}
DECODE_NOT_INFORMED = "Nao informado"
DECODE_FALLBACK_PREFIX = "Codigo "

SEX_LABELS = {"M": "Masculino", "F": "Feminino", "I": "Ignorado", "NI": "Não informado"}
RACE_LABELS = {"1": "Branca", "2": "Preta", "3": "Amarela", "4": "Parda", "5": "Indigena",
               "9": "Ignorado", "NI": "Não informado"}
AGE_UNIT_LABELS = {"1": "hora(s)", "2": "dia(s)", "3": "mes(es)", "4": "ano(s)"}
AGE_UNIT_DEFAULT = "unidade"
PREGNANCY_TEXT = {"1": "1o trimestre", "2": "2o trimestre", "3": "3o trimestre",
                  "4": "idade gestacional ignorada", "5": "no", "6": "no se aplica",
                  "9": "ignorado", "NI": "no informado"}
RACE_TEXT = {"1": "branca", "2": "preta", "3": "amarela", "4": "parda", "5": "indigena",
             "9": "ignorado", "NI": "no informado"}
SCHOOL_TEXT = {
    "0": "analfabeto", "00": "analfabeto",
    "1": "1a a 4a serie incompleta EF", "01": "1a a 4a serie incompleta EF",
    "2": "4a serie completa EF", "02": "4a serie completa EF",
    "3": "5a a 8a serie incompleta EF", "03": "5a a 8a serie incompleta EF",
    "4": "fundamental completo", "04": "fundamental completo",
    "5": "medio incompleto", "05": "medio incompleto",
    "6": "medio completo", "06": "medio completo",
    "7": "superior incompleta", "07": "superior incompleta",
    "8": "superior completa", "08": "superior completa",
    "9": "ignorado", "09": "ignorado",
    "10": "no se aplica", "99": "ignorado", "NI": "no informado",
}
MONTH_NAMES_PT = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho",
                  "agosto", "setembro", "outubro", "novembro", "dezembro")

# ---- fixed values: indicator multipliers and thresholds --------------------
PER_100K = 100000
PER_100 = 100
RISK_VOLUME_WEIGHT = 0.6
RISK_GROWTH_WEIGHT = 0.4
RISK_BANDS = ((0.75, "Critico"), (0.55, "Alto"), (0.35, "Moderado"))
RISK_BAND_DEFAULT = "Baixo"

# ---- fixed values: exam labels (by exam key of the role map) ---------------
EXAM_LABELS = {
    "chik_s1": "Chikungunya IgM Soro 1",
    "chik_s2": "Chikungunya IgM Soro 2",
    "prnt": "PRNT",
    "soro": "Dengue IgM",
    "ns1": "NS1",
    "viral": "Isolamento viral",
    "pcr": "RT-PCR",
    "histopa": "Histopatologia",
    "imunoh": "Imunohistoquimica",
}
# exams the evaluation panel counts (trap T11)
EVALUATION_EXAMS = ("soro", "ns1", "viral", "pcr")
EXAM_DONE_CLINICAL = ("1", "2", "3")
EXAM_DONE_EVALUATION = ("1", "2", "3", "4")
SEROTYPE_LABELS = {"1": "DEN 1", "2": "DEN 2", "3": "DEN 3", "4": "DEN 4"}
NO_PATTERN_LABEL = "Sem padrão clínico"
STATUS_CONFIRMED = "Confirmados"
STATUS_DISCARDED = "Descartados"
EXAM_METRICS = ("Realizados", "Positivos", "Negativos", "Não realizados")
EXAM_INCONCLUSIVE_METRIC = "Inconclusivos"
SEVERITY_METRICS = {"hosp": "Internações", "death": "Óbitos"}
TESTED_LABELS = ("Com exame", "Sem exame")
CLOSED_LABELS = ("Encerrados", "Em investigação")
MISSING_TOKENS = ("", "NI", "NULL", "NONE")
DELAY_BANDS = (("0-3", 3), ("4-7", 7), ("8-15", 15), ("+15", None))
ONSET_DELAY_MAX = 180
CLOSURE_DELAY_MAX = 365
# field labels of the evaluation completeness report, by role
QUALITY_FIELD_LABELS = {
    "hosp_raw": "Hospitalização",
    "outcome_raw": "Evolução do caso",
    "closed_on": "Data de encerramento",
    "class_raw": "Classificação final",
    "school_raw": "Escolaridade",
    "onset_on": "Data dos primeiros sintomas",
    "race_raw": "Raça/Cor",
    "sex_raw": "Sexo",
}
QUALITY_FIELDS = ("onset_on", "closed_on", "class_raw", "outcome_raw", "hosp_raw", "sex_raw",
                  "race_raw", "school_raw")

# ---- fixed values: field-validity report (E35/E36) --------------------------
VALIDITY_STATUS_NO_ROWS = "SEM_REGISTROS_NO_RECORTE"
VALIDITY_STATUS_NO_COLUMN = "COLUNA_AUSENTE"
VALIDITY_STATUS_NO_DATA = "SEM_DADO_INFORMADO"
VALIDITY_STATUS_INVALID = "PREENCHIDO_INVALIDO"
VALIDITY_STATUS_OK = "OK"
YES_NO = ("SIM", "NAO")
YES_NO_SET = ("1", "2")
EXAM_RESULT_SET = ("1", "2", "3", "4")
SEX_SET = ("M", "F", "I")
AGE_CODE_PATTERN = r"^[1-4][0-9]+\z"
PREGNANCY_SET = ("1", "2", "3", "4", "5", "6", "9")
RACE_SET = ("1", "2", "3", "4", "5", "9")
SCHOOL_SET = ("0", "00", "1", "01", "2", "02", "3", "03", "4", "04", "5", "05", "6", "06",
              "7", "07", "8", "08", "9", "09", "10", "99")

# ---- fixed values: reconciliation statuses (J09) ----------------------------
RECON_NO_LOG = "SEM_LOG"
RECON_FULL = "OK_FULL"
RECON_TOLERANCE = "OK_COM_TOLERANCIA"
RECON_DATE_ONLY = "OK_DATA_NOTIFICACAO"
RECON_YEAR_ONLY = "OK_NU_ANO"
RECON_DIVERGENT = "DIVERGENTE"
RECON_TOLERANCE_ABS = 7000
RECON_TOLERANCE_PCT = 0.5

# ---- fixed values: schema-coverage audit (K07) -----------------------------
AUDIT_SOURCE_UNMAPPED = "JSON_NAO_MAPEADO_NO_TRANSFORMADOR"
AUDIT_MAPPER_MISSING = "MAPPER_REFERENCIA_CAMPO_AUSENTE_NO_JSON"
AUDIT_OUTPUT_NO_COLUMN = "SAIDA_TRANSFORMADOR_SEM_COLUNA_NA_FATO"
AUDIT_COLUMN_NO_OUTPUT = "COLUNA_FATO_SEM_SAIDA_DO_TRANSFORMADOR"
AUDIT_OK = "OK"
AUDIT_TECHNICAL_COLUMNS = ("id", "data_carga")
