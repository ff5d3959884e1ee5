"""Curated subject terms by language. A term listed under several subjects is shared by them."""

from __future__ import annotations

TERMS: dict[str, dict[str, str]] = {
    "banking": {
        "en": "hedging; liquidity; clearing; lender; guarantor; collateral; escrow account; branch; drawdown; letter of credit; amortisation; margin call; syndicate; credit facility; loan covenant; repayment; borrower; overdraft; deposit; interest rate; capital ratio; default event; interest; mortgage charge",
        "de": "Bürgschaft; Kontoauszug; Zinssatz; Darlehen; Kreditnehmer; Sicherheit; Tilgung; Einlage; Überziehung",
        "fr": "dépôt; remboursement; taux d'intérêt; caution; emprunteur; liquidité; découvert; prêt; garantie",
        "es": "reembolso; hipoteca; préstamo; depósito; tipo de interés; prestatario; liquidez; aval; descubierto",
    },
    "data_protection": {
        "en": "processor; supervisory authority; impact assessment; personal data; cookie; portability; controller; consent form; anonymisation; erasure; retention period; data subject; privacy policy; opt-out; transfer clause; profiling; data breach; access request; audit log; sensitive data; encryption; server; contractor; publication",
        "de": "Einwilligung; Datenschutz; Datenpanne; Auftragsverarbeitung; Aufsichtsbehörde; Betroffener; Löschung",
        "fr": "données personnelles; témoin de connexion; consentement; anonymisation; fuite de données; sous-traitant; effacement",
        "es": "consentimiento; brecha de datos; anonimización; datos personales; encargado del tratamiento; supresión",
    },
    "employment": {
        "en": "maternity leave; redundancy; dismissal; night shift; apprenticeship; trade union; overtime; wage; staff handbook; workplace grievance; severance; works council; pension scheme; salary band; employer; probation; collective bargaining; recruitment; shift roster; sick pay; bonus; payroll; settlement; contractor",
        "de": "Überstunden; Arbeitszeit; Betriebsrat; Lohn; Probezeit; Kündigung; Urlaubsanspruch; Gewerkschaft; Abfindung",
        "fr": "prime; licenciement; salaire; embauche; syndicat; période d'essai; heures supplémentaires; congé",
        "es": "contratación; despido; periodo de prueba; salario; nómina; horas extra; permiso; sindicato",
    },
    "environment": {
        "en": "climate target; discharge consent; pollutant; air quality; groundwater; landfill; carbon permit; noise limit; river basin; habitat; effluent; wetland; remediation; forest reserve; emission; wastewater; biodiversity; recycling; hazardous waste; monitoring well; contaminated soil; survey; levy; spill",
        "de": "Schadstoff; Feuchtgebiet; Altlast; Grundwasser; Emission; Artenschutz; Deponie; Abwasser; Luftqualität",
        "fr": "zone humide; eaux usées; décharge; nappe phréatique; émission; sol pollué; biodiversité; qualité de l'air",
        "es": "acuífero; suelo contaminado; biodiversidad; aguas residuales; calidad del aire; vertedero; emisión; humedal",
    },
    "healthcare": {
        "en": "nurse; ethics board; surgery; hospital; health record; diagnosis; physician; pharmacy; clinical trial; vaccine; placebo; prescription; dosage; adverse reaction; treatment plan; medical device; informed consent; therapy; patient; laboratory sample; ward; sensitive data; expert report; sick pay",
        "de": "Arzneimittel; Impfstoff; Diagnose; Rezept; Dosierung; Nebenwirkung; Pflege; Chirurgie; Klinik; Patient",
        "fr": "vaccin; infirmier; diagnostic; essai clinique; médicament; patient; ordonnance; chirurgie; posologie; hôpital",
        "es": "cirugía; hospital; ensayo clínico; paciente; dosis; enfermero; diagnóstico; vacuna; receta; medicamento",
    },
    "insurance": {
        "en": "insurance cover; peril; no-claims discount; liability cover; deductible; policyholder; loss ratio; subrogation; premium; reinsurance; salvage; broker commission; insured loss; claims adjuster; solvency; exclusion clause; actuary; annuity; endorsement; indemnity limit; underwriter; policy wording; spill; expert report",
        "de": "Rückversicherung; Schadenquote; Prämie; Selbstbehalt; Versicherungsnehmer; Deckung; Police; Haftpflicht",
        "fr": "prime d'assurance; assuré; police; sinistre; franchise; souscripteur; courtier; indemnité; réassurance",
        "es": "perito; corredor; prima; póliza; indemnización; reaseguro; asegurado; siniestro; franquicia",
    },
    "intellectual_property": {
        "en": "know-how; invention; claim chart; trade secret; moral rights; novelty search; infringement; counterfeit; patent family; examiner; prior art; design right; utility model; patent; trademark; inventor; royalty; licensee; copyright; assignment of marks; settlement; publication; licence; logo",
        "de": "Patent; Geschäftsgeheimnis; Gebrauchsmuster; Marke; Urheberrecht; Schutzrecht; Lizenzgebühr; Erfindung",
        "fr": "redevance; savoir-faire; marque; contrefaçon; brevet; invention; droit d'auteur; licence",
        "es": "secreto industrial; derecho de autor; patente; falsificación; regalía; marca registrada; invención",
    },
    "litigation": {
        "en": "remand; jury; defendant; summons; arbitrator; tribunal; pleading; injunction; cross-examination; limitation period; docket; evidence bundle; judgment; hearing; witness statement; plaintiff; costs order; counterclaim; discovery; affidavit; settlement; appeal; expert report; penalty",
        "de": "Widerklage; Berufung; Beweisaufnahme; Urteil; Verjährung; Beklagter; Schiedsgericht; Zeuge; Kläger",
        "fr": "appel; tribunal; défendeur; témoin; prescription; demandeur; audience; jugement; assignation; arbitre",
        "es": "audiencia; árbitro; sentencia; testigo; demandado; reconvención; demandante; prueba; recurso; tribunal",
    },
    "real_estate": {
        "en": "leasehold; easement; floor area; building permit; parking bay; tenant; premises; landlord; service charge; eviction; sublease; freehold; zoning; rent review; boundary wall; dilapidations; foundation works; property manager; title deed; cadastre; insurance cover; survey; exemption; mortgage charge",
        "de": "Nebenkosten; Grundbuch; Baugenehmigung; Vermieter; Mieter; Grundstück; Wohnfläche; Räumung; Pachtvertrag",
        "fr": "bail commercial; cadastre; locataire; bailleur; expulsion; copropriété; loyer; permis de construire",
        "es": "licencia de obra; inquilino; catastro; alquiler; finca; arrendador; solar; escritura; desahucio",
    },
    "software": {
        "en": "patch; backup; developer; version history; repository; bug report; database; uptime; maintenance window; hosting; application interface; integration; software release; source code; test suite; deployment; escrow build; latency; cloud service; user account; open source; licence; encryption; server",
        "de": "Wartungsfenster; Schnittstelle; Verfügbarkeit; Quellcode; Entwickler; Fehlerbericht; Datenbank; Sicherung",
        "fr": "hébergement; déploiement; interface; sauvegarde; développeur; correctif; code source; base de données",
        "es": "copia de seguridad; base de datos; interfaz; parche; alojamiento; código fuente; despliegue; desarrollador",
    },
    "sport": {
        "en": "fixture list; doping test; sponsorship; season ticket; club academy; match fee; kit supplier; squad; training ground; league; relegation; player transfer; goalkeeper; stadium; disciplinary panel; championship; coach; athlete; referee; tournament; broadcast rights; logo; bonus; appeal",
        "de": "Turnier; Dauerkarte; Spielerwechsel; Stadion; Abstieg; Meisterschaft; Schiedsrichter; Trainer; Torwart; Liga",
        "fr": "gardien de but; tournoi; athlète; relégation; championnat; ligue; stade; billetterie; arbitre de match; entraîneur",
        "es": "portero; torneo; descenso; estadio; atleta; entrenador; campeonato; liga; abono; árbitro de campo",
    },
    "taxation": {
        "en": "customs duty; withholding tax; tax residence; capital gains; stamp duty; tax credit; tax authority; taxable income; double taxation; depreciation; loss carry-forward; tax return; value added tax; transfer pricing; assessment notice; excise; tax audit; deduction; rebate; interest; payroll; levy; penalty; exemption",
        "de": "Quellensteuer; Abschreibung; Umsatzsteuer; Finanzamt; Steuerbescheid; Steuererklärung; Zollabgabe; Freibetrag",
        "fr": "taxe; douane; amortissement; exonération; redressement; déclaration fiscale; retenue à la source; impôt",
        "es": "inspección tributaria; retención; arancel; declaración fiscal; amortización fiscal; aduana; impuesto; exención",
    },
}

#: Phrases that hold a term's words and say nothing of a subject.
NEUTRAL = {"es": "sin prueba sobre; a prueba", "fr": "faute de preuve sur; droit de marque", "en": "in the interest of; prior appeal of", "de": ""}

#: Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to for was by be is under which that with must shall",
    "de": "der die das und für von nicht über den zu vom hat keine eine",
    "fr": "le la les et des sur est sous du un une pour non au",
    "es": "el los las y del por una no que en se al con",
}
