"""Fixed values.

Word lists, code lists, patterns, weights and limits that define the results.
They are given, not derived: changing one changes the answers.
"""

from __future__ import annotations


# ---------------------------------------------------------------- fixed values: terms

TERM_PATTERN = r"^(?!\d+$)[a-z0-9]{2,}$"

STOP_WORDS = [
    "de", "do", "da", "dos", "das", "para", "com", "por", "que", "uma", "um", "seu", "sua", "nos", "nas", "pelo",
    "pela", "aos", "entre", "sobre", "apos", "ate", "sem", "como", "mais", "este", "esta", "esse", "essa", "ser",
    "ter", "seus", "suas", "tipo", "lote", "item", "itens", "conforme", "especificacao", "descricao", "complementar",
    "referencia", "marca", "modelo", "similar", "equivalente", "minimo", "maximo", "aproximadamente", "aproximado",
    "sendo", "devera", "dever", "podera", "poder", "forma", "acordo", "seguinte", "demais", "contratacao", "empresa",
    "especializada", "aquisicao", "fornecimento", "objeto", "registro", "preco", "precos", "modalidade", "processo",
    "licitatorio", "pregao", "eletronico", "presencial",
]

SYNONYMS = {
    "sistema": "software", "sistemas": "software", "solucao": "software", "gestao": "gerenciamento",
    "administracao": "gerenciamento", "microcomputador": "computador", "microcomputadores": "computador",
    "notebook": "computador", "notebooks": "computador", "desktop": "computador", "workstation": "computador",
    "multifuncional": "impressora", "multifuncionais": "impressora", "impressoras": "impressora",
    "estabilizador": "nobreak", "estabilizadores": "nobreak", "permissao": "licenca", "cessao": "licenca",
    "locacao": "licenca", "licenciamento": "licenca", "licencas": "licenca", "switches": "switch",
    "roteadores": "roteador", "hd": "disco", "ssd": "disco", "mouses": "mouse", "teclados": "teclado",
    "monitores": "monitor", "suporte": "manutencao", "assistencia": "manutencao", "nuvem": "cloud", "saas": "cloud",
    "hospedagem": "cloud", "etanol": "alcool", "gasolina": "gasolina", "diesel": "diesel", "gasoleo": "diesel",
    "conserto": "manutencao", "reparo": "manutencao", "conservacao": "manutencao", "capacitacao": "treinamento",
    "instalacao": "montagem", "fornecimento": "suprimento", "atendimento": "consulta", "avaliacao": "analise",
    "chamamento": "convocacao", "credenciamento": "habilitacao", "remocao": "transporte", "retirada": "remocao",
    "terapia": "tratamento", "micro": "computador", "portatil": "notebook", "inox": "aco", "cabo": "fio",
    "conector": "ligacao", "tonner": "toner", "caminhao": "veiculo", "caminhonete": "pickup", "onibus": "veiculo",
    "carreta": "reboque", "ambulancia": "veiculo", "guincho": "socorro", "betoneira": "misturador",
    "ultrasson": "ecografia", "ultrassonografia": "ecografia", "tomografia": "exame", "ressonancia": "exame",
    "endoscopia": "exame", "colonoscopia": "exame", "biopsia": "exame", "cintilografia": "exame",
    "angiografia": "exame", "arteriografia": "exame", "cistoscopia": "exame", "ureteroscopia": "exame",
    "pediatra": "medico", "ginecologista": "medico", "ortopedista": "medico", "neurologista": "medico",
    "oftalmologista": "medico", "cardiologista": "medico", "psiquiatra": "medico", "cirurgiao": "medico",
    "dentista": "odonto", "aipim": "mandioca", "bolacha": "biscoito", "refeicao": "alimentacao",
    "pedreiro": "construtor", "carpinteiro": "marceneiro", "encanador": "hidraulico", "bombeiro": "hidraulico",
    "terraplanagem": "construcao", "embalagem": "pacote", "maco": "pacote", "tanque": "reservatorio",
    "torax": "peito", "toracica": "peito", "cervical": "pescoco", "vertebras": "coluna", "pelve": "quadril",
    "cerebral": "craniano", "pulmonar": "pulmao", "abridor": "saca", "assadeira": "forma", "batedor": "mixer",
    "cafeteira": "maquina", "caldeirao": "panela", "caneca": "xicara", "coador": "filtro", "colher": "talher",
    "concha": "talher", "copo": "recipiente", "descascador": "cortador", "espremedor": "extrator", "faca": "talher",
    "frigideira": "panela", "garfo": "talher", "panela": "recipiente", "peneira": "filtro", "prato": "vasilha",
    "ralador": "processador", "tigela": "recipiente", "balde": "recipiente", "detergente": "sabao",
    "escova": "vassoura", "esponja": "bucha", "mop": "esfregao", "pano": "trapo", "rodo": "puxador",
    "vassoura": "limpeza", "agulha": "dispositivo", "algodao": "chumaco", "autoclave": "esterilizador",
    "bandagem": "atadura", "cateter": "sonda", "curativo": "penso", "desfibrilador": "cardioversor",
    "estetoscopio": "fonendoscopio", "gaze": "compressa", "mascara": "respirador", "seringa": "dispositivo",
    "soro": "solucao", "avental": "jaleco", "bota": "calcado", "capacete": "casco", "cinto": "faixa",
    "colete": "vest", "coturno": "calcado", "luva": "protecao", "oculos": "protecao", "touca": "gorro",
    "alicate": "torques", "broca": "furadeira", "chave": "ferramenta", "disjuntor": "ferramenta", "martelo": "malho",
    "parafuso": "rosca", "prego": "fixador", "pincel": "trincha", "armario": "estante", "arquivo": "gaveteiro",
    "cadeira": "assento", "cofre": "arca", "colchao": "cama", "cortina": "persiana", "gaveta": "compartimento",
    "luminaria": "lampada", "mesa": "bancada", "prateleira": "estante", "quadro": "painel", "cartucho": "toner",
    "cola": "adesivo", "envelope": "sobrecarta", "etiqueta": "rotulo", "fita": "adesivo", "fitilho": "adesivo",
    "aquecedor": "radiador", "bebedouro": "purificador", "compressor": "bomba", "destilador": "purificador",
    "dispenser": "suporte", "eletroduto": "conduite", "extensao": "fio", "fechadura": "trinco", "rolo": "cilindro",
    "ventilador": "circulador", "carrinho": "carro", "etilico": "alcool", "tinta": "verniz",
}

# ---------------------------------------------------------------- fixed values: units

UNIT_GROUPS = [
    ["un", "und", "unid", "unidade", "peca", "pc"],
    ["kg", "quilo", "quilograma"],
    ["l", "lt", "litro"],
    ["m", "metro", "metro linear"],
    ["ml", "mililitro"],
    ["m2", "m²", "metro quadrado"],
    ["m3", "m³", "metro cubico"],
    ["cx", "caixa"],
    ["pct", "pacote"],
    ["fr", "frasco"],
    ["tb", "tubo"],
    ["rl", "rolo"],
    ["mes", "mensal", "meses"],
    ["hora", "h", "hr"],
    ["ano", "anual", "anos"],
    ["diaria", "dia", "dias"],
    ["par", "pares"],
    ["dz", "duzia", "dzia"],
]

# ---------------------------------------------------------------- fixed values: categories

# Checked in this order; anything else is a "produto".
CATEGORY_WORDS = {
    "servico": [
        "servico", "servicos", "manutencao", "suporte", "assistencia", "consultoria", "treinamento", "capacitacao",
        "instalacao", "configuracao", "prestacao", "execucao", "operacao", "assessoria", "auditoria", "monitoramento",
    ],
    "licenca": [
        "licenca", "cessao", "permissao", "locacao", "licenciamento", "saas", "cloud", "hospedagem", "software",
        "sistema", "assinatura", "plataforma", "aplicativo", "app",
    ],
    "consumivel": [
        "gasolina", "diesel", "alcool", "etanol", "combustivel", "papel", "toner", "cartucho", "tinta", "limpeza",
        "higiene", "descartavel", "agua", "alimento", "genero",
    ],
}
DEFAULT_CATEGORY = "produto"

INCOMPATIBLE_CATEGORIES = [
    ("servico", "produto"),
    ("servico", "consumivel"),
    ("licenca", "consumivel"),
    ("licenca", "produto"),
]

MAX_SCALE_RATIO = {"produto": 20.0, "consumivel": 20.0, "licenca": 5.0, "servico": 10.0}
MAX_SCALE_RATIO_DEFAULT = 20.0

SERVICE_WORDS = [
    "licenca", "cessao", "permissao", "locacao", "software", "sistema", "saas", "cloud", "hospedagem", "assinatura",
    "plataforma", "servico", "manutencao", "suporte", "consultoria", "treinamento", "implantacao", "desenvolvimento",
    "configuracao",
]
MATERIAL_WORDS = [
    "aquisicao", "equipamento", "veiculo", "ambulancia", "computador", "notebook", "impressora", "servidor",
    "monitor", "mobiliario", "mesa", "cadeira", "trator", "caminhao", "picador",
]

# ---------------------------------------------------------------- fixed values: prospecting

HIGH_TERMS = [
    "permissão de uso", "licença de uso", "cessão de uso", "locação de software",
    "sistema integrado de gestão", "hospedagem de e-mails", "e-mails institucionais",
]
MEDIUM_TERMS = ["software", "sistema de gestão", "solução tecnológica", "email", "e-mail"]

SEARCH_HIGH_TERMS = HIGH_TERMS + [
    "software", "sistema", "sistema de gestão", "e-mail", "gestão pública",
]
SEARCH_MEDIUM_TERMS = ["solução tecnológica", "email", "e-mail"]

SMALL_BUSINESS_BENEFITS = [1, 2, 3]

MODALITY_NAMES = {
    2: "Diálogo Competitivo",
    3: "Concurso",
    4: "Concorrência Eletrônica",
    5: "Concorrência Presencial",
    6: "Pregão Eletrônico",
    7: "Pregão Presencial",
    8: "Dispensa de Licitação",
    9: "Inexigibilidade",
    10: "Manifestação de Interesse",
    11: "Pré-qualificação",
    12: "Credenciamento",
}

# upper population bound of each coefficient step; beyond the last: 4.0 / 999999
FPM_STEPS = [
    (10188, 0.6), (13584, 0.8), (16980, 1.0), (23772, 1.2), (30564, 1.4), (37356, 1.6),
    (44148, 1.8), (50940, 2.0), (61128, 2.2), (71316, 2.4), (81504, 2.6), (91692, 2.8),
    (101880, 3.0), (115464, 3.2), (129048, 3.4), (142632, 3.6), (156216, 3.8),
]
FPM_ABOVE = 4.0
POPULATION_UNKNOWN = 999999

NOTICE_URL_BASE = "https://pncp.gov.br/app/editais"
NOTICE_URL_PATTERN = r"/editais/([^/]+)/(\d+)/(\d+)"

RELEVANCE_ORDER = ["ALTA", "MEDIA", "BAIXA"]
OPEN_PIPELINE_STATUSES = ["identificada", "analisando", "preparando_proposta", "proposta_enviada"]
CLOSED_STATUSES = ["ganha", "perdida", "descartada"]
ALERT_DAYS = [3, 1, 0]

# ---------------------------------------------------------------- fixed values: platforms

COMPETITOR_PLATFORM_IDS = [121, 12, 13, 18, 3, 5, 90]

# id, name, type
PLATFORMS = [
    (121, "SH3 Informática Ltda.", "concorrente_direta"),
    (12, "BLL Compras (Bolsa Nacional De Compras - BNC)", "concorrente_direta"),
    (13, "Licitar Digital", "concorrente_direta"),
    (18, "Licitanet Licitações Eletrônicas LTDA", "concorrente_direta"),
    (3, "Compras.gov.br", "plataforma_licitacao"),
    (5, "ECustomize Consultoria em Software S.A", "plataforma_licitacao"),
    (90, "Novo BBMNET Licitações", "plataforma_licitacao"),
    (10, "Portal de Compras do Estado de Minas Gerais", "portal_estadual"),
    (14, "Portal de Compras Públicas do Estado do Rio de Janeiro", "portal_estadual"),
    (16, "Compras Pará", "portal_estadual"),
    (26, "Memory Projetos e Desenvolvimento de Sistemas LTDA", "sistema_gestao"),
    (27, "HLH Assessoria e Consultoria Ltda", "sistema_gestao"),
    (30, "Ascontech Solutions", "sistema_gestao"),
    (32, "Central de Compras da Paraíba/PB", "portal_estadual"),
    (40, "Licitações-E BB", "plataforma_licitacao"),
    (41, "Elotech Gestão Pública Ltda", "sistema_gestao"),
    (42, "4R Tecnologia da Informação Ltda", "sistema_gestao"),
    (51, "Secretaria do Planejamento e Gestão do Ceará", "portal_estadual"),
    (54, "Diretriz Informática Eireli", "sistema_gestao"),
    (55, "IPM Sistemas", "sistema_gestao"),
    (59, "IBDM Modernização Assessoria e Consultoria", "sistema_gestao"),
    (63, "CECAM", "sistema_gestao"),
    (67, "DBseller Serviços de Informática", "sistema_gestao"),
    (77, "LicitaCon - TCE-RS", "portal_estadual"),
    (80, "Elmar Tecnologia", "sistema_gestao"),
    (82, "Governançabrasil Tecnologia e Gestão em Serviços", "sistema_gestao"),
    (84, "Betha Sistemas", "sistema_gestao"),
    (85, "Grupo Assessor", "sistema_gestao"),
    (88, "M2A Tecnologia", "sistema_gestao"),
    (89, "Licita + Brasil", "plataforma_licitacao"),
    (91, "SEAP Paraná", "portal_estadual"),
    (94, "Sigep - Sistemas Integrados", "sistema_gestao"),
    (96, "BR Conectado", "plataforma_licitacao"),
    (99, "Instituto Municipal de Administração Pública - IMAP", "sistema_gestao"),
    (100, "Tecnosweb - Tecnologia de Gestão", "sistema_gestao"),
    (102, "SMARAPD Informática LTDA", "sistema_gestao"),
    (109, "STS Informática Ltda", "sistema_gestao"),
    (120, "Lemarq Software", "sistema_gestao"),
    (131, "PROCERGS", "portal_estadual"),
    (133, "CONAM Consultoria em Administração Municipal", "sistema_gestao"),
    (135, "Pública Tecnologia Ltda.", "sistema_gestao"),
    (139, "EMBRAS", "sistema_gestao"),
    (141, "Secretaria de Estado da Administração de Santa Catarina", "portal_estadual"),
    (144, "JL Alves Gestão", "sistema_gestao"),
    (145, "EMPRO Tecnologia e Informação", "sistema_gestao"),
]

# ---------------------------------------------------------------- fixed values: code lists

DOMAIN_CODES = {
    "instrumento_convocatorio": {
        1: "Edital",
        2: "Aviso de Contratação Direta",
        3: "Ato que autoriza a Contratação Direta",
    },
    "modalidade_contratacao": {
        1: "Leilão - Eletrônico",
        2: "Diálogo Competitivo",
        3: "Concurso",
        4: "Concorrência - Eletrônica",
        5: "Concorrência - Presencial",
        6: "Pregão - Eletrônico",
        7: "Pregão - Presencial",
        8: "Dispensa de Licitação",
        9: "Inexigibilidade",
        10: "Manifestação de Interesse",
        11: "Pré-qualificação",
        12: "Credenciamento",
        13: "Leilão - Presencial",
    },
    "modo_disputa": {
        1: "Aberto",
        2: "Fechado",
        3: "Aberto-Fechado",
        4: "Dispensa Com Disputa",
        5: "Não se aplica",
        6: "Fechado-Aberto",
    },
    "criterio_julgamento": {
        1: "Menor preço",
        2: "Maior desconto",
        4: "Técnica e preço",
        5: "Maior lance",
        6: "Maior retorno econômico",
        7: "Não se aplica",
        8: "Melhor técnica",
        9: "Conteúdo artístico",
    },
    "situacao_item_contratacao": {
        1: "Em Andamento",
        2: "Homologado",
        3: "Anulado/Revogado/Cancelado",
        4: "Deserto",
        5: "Fracassado",
    },
    "tipo_beneficio": {
        1: "Participação exclusiva para ME/EPP",
        2: "Subcontratação para ME/EPP",
        3: "Cota reservada para ME/EPP",
        4: "Sem benefício",
        5: "Não se aplica",
    },
    "tipo_contrato": {
        1: "Contrato (termo inicial)",
        2: "Comodato",
        3: "Arrendamento",
        4: "Concessão",
        5: "Termo de Adesão",
        6: "Convênio",
        7: "Empenho",
        8: "Outros",
        9: "Termo de Execução Descentralizada (TED)",
        10: "Acordo de Cooperação Técnica (ACT)",
        11: "Termo de Compromisso",
        12: "Carta Contrato",
    },
    "categoria_processo": {
        1: "Cessão",
        2: "Compras",
        3: "Informática (TIC)",
        4: "Internacional",
        5: "Locação Imóveis",
        6: "Mão de Obra",
        7: "Obras",
        8: "Serviços",
        9: "Serviços de Engenharia",
        10: "Serviços de Saúde",
        11: "Alienação de bens móveis/imóveis",
    },
    "tipo_documento": {
        1: "Aviso de Contratação Direta",
        2: "Edital",
        3: "Minuta do Contrato",
        4: "Termo de Referência",
        5: "Anteprojeto",
        6: "Projeto Básico",
        7: "Estudo Técnico Preliminar",
        8: "Projeto Executivo",
        9: "Mapa de Riscos",
        10: "DFD",
        11: "Ata de Registro de Preço",
        12: "Contrato",
        13: "Termo de Rescisão",
        14: "Termo Aditivo",
        15: "Termo de Apostilamento",
        16: "Outros documentos do processo",
        17: "Nota de Empenho",
        18: "Relatório Final de Contrato",
    },
    "porte_empresa": {
        1: "ME",
        2: "EPP",
        3: "Demais",
        4: "Não se aplica",
        5: "Não informado",
    },
    "categoria_item_pca": {
        1: "Material",
        2: "Serviço",
        3: "Obras",
        4: "Serviços de Engenharia",
        5: "Soluções de TIC",
        6: "Locação de Imóveis",
        7: "Alienação/Concessão/Permissão",
        8: "Obras e Serviços de Engenharia",
    },
}

# ---------------------------------------------------------------- fixed values: portals

# first phrase found in the text decides
PORTAL_MODALITIES = [
    ("pregão eletrônico", "Pregão Eletrônico"),
    ("pregão presencial", "Pregão Presencial"),
    ("pregao eletronico", "Pregão Eletrônico"),
    ("pregao presencial", "Pregão Presencial"),
    ("tomada de preço", "Tomada de Preços"),
    ("tomada de preco", "Tomada de Preços"),
    ("concorrência", "Concorrência"),
    ("concorrencia", "Concorrência"),
    ("convite", "Convite"),
    ("dispensa", "Dispensa de Licitação"),
    ("inexigibilidade", "Inexigibilidade"),
    ("leilão", "Leilão"),
    ("leilao", "Leilão"),
    ("chamamento público", "Chamamento Público"),
    ("chamamento publico", "Chamamento Público"),
    ("credenciamento", "Credenciamento"),
]
PROCESS_NUMBER_PATTERN = (
    r"(?:processo|proc|nº|n°|numero|número|pregão|pe|pp|tp|cc|dl)\s*[.:nº°-]*\s*(\d{1,4}[/.-]\d{2,4})"
)
BR_DATE_PATTERN = r"\b(\d{2})/(\d{2})/(\d{2,4})\b"
BR_MONEY_PATTERN = r"R\$\s*([\d.,]+)"
NOTICE_LINK_PATTERN = (
    r"licita[çc][ãa]o|licita[çc][õo]es|editais|preg[ãa]o|tomada.+pre[çc]o|concorr[êe]ncia"
)
CARD_CLASS_PATTERN = r"licit|edital|processo|card|item|post"
LISTING_HEADER_WORDS = [
    "objeto", "licitação", "licitacao", "descrição", "descricao", "processo", "edital",
]
LISTING_COLUMNS = [
    ("subject", ["objeto", "descrição", "descricao"]),
    ("modality", ["modalidade", "tipo"]),
    ("process", ["processo", "número", "numero", "nº", "edital"]),
    ("date", ["data", "publicação", "publicacao", "abertura"]),
    ("value", ["valor", "estimado"]),
    ("status", ["situação", "situacao", "status"]),
]

# ---------------------------------------------------------------- fixed values: documents

LEGAL_TERMS = [
    "edital", "licitação", "licitacao", "contrato", "pregão", "pregao", "dispensa", "habilitação", "habilitacao",
    "proposta", "certidão", "certidao", "modalidade", "objeto", "cláusula", "clausula", "penalidade", "sanção",
    "sancao", "multa", "garantia", "prazo", "adjudicação", "adjudicacao", "homologação", "homologacao",
]

# (code, label, pattern), in taxonomy order
DOCUMENT_PATTERNS = [
    ("DOC_CERTIDAO_FEDERAL", "Certidão negativa federal",
     r"certid[ãa]o\s+(?:negativa\s+)?(?:de\s+)?[\w\s]+federal"),
    ("DOC_CERTIDAO_ESTADUAL", "Certidão negativa estadual",
     r"certid[ãa]o\s+(?:negativa\s+)?(?:de\s+)?[\w\s]+estadual"),
    ("DOC_CERTIDAO_MUNICIPAL", "Certidão negativa municipal",
     r"certid[ãa]o\s+(?:negativa\s+)?(?:de\s+)?[\w\s]+municipal"),
    ("DOC_CERTIDAO_TRABALHISTA", "Certidão negativa trabalhista",
     r"certid[ãa]o\s+(?:negativa\s+)?(?:de\s+)?[\w\s]+trabalhista"),
    ("DOC_FGTS", "Certidão de regularidade FGTS",
     r"certid[ãa]o\s+(?:negativa\s+)?(?:de\s+)?[\w\s]+FGTS"),
    ("DOC_INSS", "Certidão de regularidade INSS",
     r"certid[ãa]o\s+(?:negativa\s+)?(?:de\s+)?[\w\s]+INSS"),
    ("DOC_ATESTADO_CAPACIDADE", "Atestado de capacidade técnica",
     r"atestado\s+de\s+capacidade\s+t[ée]cnica"),
    ("DOC_CONTRATO_SOCIAL", "Contrato social / Ato constitutivo",
     r"contrato\s+social|ato\s+constitutivo"),
    ("DOC_BALANCO_PATRIMONIAL", "Balanço patrimonial", r"balan[çc]o\s+patrimonial"),
    ("DOC_JUNTA_COMERCIAL", "Certidão da Junta Comercial",
     r"certid[ãa]o\s+(?:simplificada\s+)?(?:da\s+)?junta\s+comercial"),
    ("DOC_CNPJ", "Comprovante de inscrição no CNPJ",
     r"comprovante\s+de\s+inscri[çc][ãa]o\s+(?:no\s+)?CNPJ"),
    ("DOC_ALVARA", "Alvará de funcionamento", r"alvar[áa]\s+de\s+funcionamento"),
    ("DOC_DECLARACAO_MENOR", "Declaração de não emprego de menor",
     r"declara[çc][ãa]o\s+(?:de\s+)?(?:que\s+)?(?:n[ãa]o\s+)?(?:emprega|utiliza)\s+(?:menor|trabalho\s+infantil)"),
    ("DOC_DECLARACAO_IDONEIDADE", "Declaração de idoneidade",
     r"declara[çc][ãa]o\s+de\s+idoneidade"),
    ("DOC_DECLARACAO_IMPEDITIVOS", "Declaração de inexistência de fatos impeditivos",
     r"declara[çc][ãa]o\s+de\s+inexist[êe]ncia\s+de\s+fatos?\s+impeditivos?"),
    ("DOC_REGISTRO_CONSELHO", "Registro em conselho profissional",
     r"registro\s+(?:no\s+)?(?:conselho|CRA|CRC|CREA|CAU|OAB)"),
    ("DOC_CERTIDAO_FISCAL", "Certidão de regularidade fiscal",
     r"certid[ãa]o\s+de\s+(?:regularidade|d[ée]bitos?)\s+(?:fiscal|tribut[áa]ria)"),
    ("DOC_CERTIDAO_FISCAL", "Certidão de regularidade fiscal",
     r"prova\s+de\s+regularidade\s+(?:fiscal|para\s+com)"),
    ("DOC_GARANTIA_PROPOSTA", "Garantia de proposta / Caução",
     r"garantia\s+(?:de\s+)?proposta|cau[çc][ãa]o"),
]

REQUIREMENT_PATTERNS = [
    ("REQ_TECNICO", "Requisito técnico", pattern) for pattern in [
        r"(?:dever[áa]|deve)\s+(?:possuir|apresentar|comprovar|demonstrar|dispor\s+de)\s+[^.;]{10,120}",
        r"requisito[s]?\s+t[ée]cnico[s]?\s*[:]\s*[^.;]{10,200}",
        r"especifica[çc][ãa]o\s+t[ée]cnica[s]?\s*[:]\s*[^.;]{10,200}",
        r"(?:sistema|software|solu[çc][ãa]o)\s+(?:deve|dever[áa])\s+[^.;]{10,150}",
        r"funcionalidade[s]?\s+(?:m[íi]nima[s]?|obrigat[óo]ria[s]?)\s*[:]\s*[^.;]{10,200}",
        r"m[óo]dulo[s]?\s+(?:de|do|da)\s+[\w\s]+(?:deve|dever[áa]|com)\s+[^.;]{10,150}",
        r"integra[çc][ãa]o\s+(?:com|ao|entre)\s+[^.;]{10,120}",
        r"migra[çc][ãa]o\s+(?:de\s+)?dados?\s+[^.;]{10,120}",
        r"treinamento|capacita[çc][ãa]o\s+[^.;]{10,120}",
        r"suporte\s+t[ée]cnico\s+[^.;]{10,120}",
    ]
]

RISK_PATTERNS = [
    ("RISCO_MULTA", "Multa contratual",
     r"multa\s+(?:de\s+)?(?:\d+[%,]|[\w\s]+por\s+cento)\s*[^.;]{5,120}"),
    ("RISCO_PENALIDADE", "Penalidades", r"penalidade[s]?\s*[:]\s*[^.;]{10,200}"),
    ("RISCO_SANCAO", "Sanções administrativas",
     r"san[çc][ãa]o|san[çc][õo]es\s+[^.;]{10,150}"),
    ("RISCO_RESCISAO", "Rescisão contratual",
     r"rescis[ãa]o\s+(?:do\s+)?contrato\s+[^.;]{10,120}"),
    ("RISCO_GARANTIA_CONTRATUAL", "Garantia contratual",
     r"garantia\s+(?:contratual|de\s+execu[çc][ãa]o)\s+(?:de\s+)?(?:\d+[%])\s*[^.;]{5,100}"),
    ("RISCO_RETENCAO_PAGAMENTO", "Retenção de pagamento",
     r"reten[çc][ãa]o\s+(?:de\s+)?(?:pagamento|valor)\s+[^.;]{10,120}"),
    ("RISCO_SUSPENSAO", "Suspensão temporária",
     r"suspens[ãa]o\s+(?:tempor[áa]ria|do\s+direito)\s+[^.;]{10,120}"),
    ("RISCO_IMPEDIMENTO_CONTRATAR", "Impedimento de licitar/contratar",
     r"impedimento\s+de\s+(?:licitar|contratar)\s+[^.;]{10,120}"),
]
RISK_WEIGHTS = {
    "RISCO_MULTA": 15,
    "RISCO_PENALIDADE": 10,
    "RISCO_SANCAO": 10,
    "RISCO_RESCISAO": 10,
    "RISCO_GARANTIA_CONTRATUAL": 15,
    "RISCO_RETENCAO_PAGAMENTO": 10,
    "RISCO_SUSPENSAO": 15,
    "RISCO_IMPEDIMENTO_CONTRATAR": 20,
}

QUALIFICATION_PATTERNS = [
    ("QUAL_HABILITACAO_JURIDICA", "Habilitação jurídica",
     r"habilita[çc][ãa]o\s+jur[íi]dica\s*[:]\s*[^.;]{10,200}"),
    ("QUAL_HABILITACAO_TECNICA", "Qualificação técnica",
     r"habilita[çc][ãa]o\s+t[ée]cnica\s*[:]\s*[^.;]{10,200}"),
    ("QUAL_HABILITACAO_TECNICA", "Qualificação técnica",
     r"qualifica[çc][ãa]o\s+t[ée]cnica\s*[:]\s*[^.;]{10,200}"),
    ("QUAL_HABILITACAO_ECONOMICA", "Qualificação econômico-financeira",
     r"habilita[çc][ãa]o\s+econ[ôo]mica\s*[:]\s*[^.;]{10,200}"),
    ("QUAL_HABILITACAO_ECONOMICA", "Qualificação econômico-financeira",
     r"qualifica[çc][ãa]o\s+econ[ôo]mica\s*[:]\s*[^.;]{10,200}"),
    ("QUAL_REGULARIDADE_FISCAL", "Regularidade fiscal",
     r"regularidade\s+fiscal\s+[^.;]{10,150}"),
    ("QUAL_CAPITAL_SOCIAL", "Capital social mínimo",
     r"capital\s+(?:social|m[íi]nimo)\s+(?:de\s+)?R?\$?\s*[\d.,]+"),
    ("QUAL_PATRIMONIO_LIQUIDO", "Patrimônio líquido mínimo",
     r"patrim[ôo]nio\s+l[íi]quido\s+(?:m[íi]nimo\s+)?(?:de\s+)?R?\$?\s*[\d.,]+"),
    ("QUAL_FATURAMENTO", "Faturamento mínimo",
     r"faturamento\s+(?:m[íi]nimo|bruto|anual)\s+[^.;]{10,120}"),
    ("QUAL_EXPERIENCIA", "Experiência mínima",
     r"experi[êe]ncia\s+(?:m[íi]nima\s+)?(?:de\s+)?(?:\d+)\s*(?:anos?|meses?)\s*[^.;]{5,100}"),
]

# each: group 1 = amount, group 2 = unit
DEADLINE_PATTERNS = [
    r"prazo\s+(?:de\s+)?(?:vig[êe]ncia|execu[çc][ãa]o|entrega|implanta[çc][ãa]o|contrato)\s*(?:[:=]|(?:de|ser[áa]\s+de))\s*(\d+)\s*(dias?|meses?|anos?|horas?)",
    r"(\d+)\s*\(\s*[\w\s]+\)\s*(dias?|meses?|anos?)\s*(?:corridos?|[úu]teis?)?(?:\s*(?:para|de)\s+[\w\s]+)?",
    r"(?:no\s+prazo\s+de|em\s+at[ée])\s*(\d+)\s*(dias?|meses?|anos?|horas?)",
]
# first kind with a word in the context wins
DEADLINE_KINDS = [
    ("vigencia", ["vigência", "vigencia", "duração do contrato", "duracao"]),
    ("execucao", ["execução", "execucao"]),
    ("entrega", ["entrega", "fornecimento"]),
    ("implantacao", ["implantação", "implantacao", "implementação", "implementacao"]),
    ("pagamento", ["pagamento", "fatura"]),
    ("suporte", ["suporte", "manutenção", "manutencao"]),
    ("recurso", ["recurso", "impugnação", "impugnacao"]),
    ("assinatura", ["assinatura", "contratação", "contratacao"]),
    ("garantia", ["garantia"]),
]

SECONDARY_FILE_WORDS = ["anexo", "aviso", "extrato", "minuta", "ata", "errata"]

# Display names of the notice report.
REPORT_COLUMNS = {
    "relevance": "Relevância", "municipality": "Município", "state": "UF", "org_tax_id": "CNPJ Órgão",
    "subject": "Objeto", "modality": "Modalidade", "estimate": "Valor Estimado", "awarded": "Valor Homologado",
    "status": "Situação", "published_at": "Data Publicação", "closes_at": "Encerramento Proposta",
}
