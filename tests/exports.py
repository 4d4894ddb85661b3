"""Synthetic exports and the decisions and cohorts that go with them.

Fixed values: the rows that the expected counts in the tests belong to.
"""

EXPORTS = {
    "export_01_individus.csv": """\
ClePers,NomUsuel,Prenom,AnneeN,CiviliteSexe,CleAdh,Site,LibEmploi,UT_Lib,DatePrisePoste,DateSortiePoste,Suiv,TelPortable
S001,Martin,Aline,1974,Femme,A100,E10,Aide soignante,EHPAD - Unite Alzheimer,2018-04-01,,SIA,0600000001
S002,Bernard,Karim,1982,M,A101,E11,Menuisier poseur,Atelier bois,2020-01-15,,SIR,0600000002
S003,Dubois,Nadia,1968,F,A100,E10,ASH,Bionettoyage,2016-09-10,,SIA,0600000003
S004,Leroy,Marc,1971,H,A102,E12,Agent logistique,Quai livraison,2019-11-20,,SIR,0600000004
""",
    "export_02_structures.csv": """\
CleAdh,Site,Adherent,Siret,APE,Nb,Territoire
A100,E10,Clinique,12345678900011,8610Z,180,Auvergne-Rhone-Alpes
A101,E11,Bois SARL,98765432100022,4332A,22,Auvergne-Rhone-Alpes
A102,E12,Logistique Sud,11122233300044,5229B,8,Auvergne-Rhone-Alpes
""",
    "export_03_actes.csv": """\
ClePers,Jour,Nature,Raison,Decision,Reserve,Adaptation,Intervenant,CR
S001,2024-02-12,VR,AT > 30 jours,apte avec restrictions,Port de charges <= 5 kg,poste amenage,Medecin du travail,Douleurs lombaires
S002,2024-03-18,VIP,periodique,apte,,non,Infirmier sante travail,
S003,2024-05-02,pre reprise,arret long,orientation PDP,,amenagement horaire,Medecin du travail,Situation PDP
S004,2024-06-14,occasionnelle,demande salarie,avis complementaire,Pas de conduite prolongee,a etudier,Medecin du travail,Fatigue persistante
""",
    "export_04_risques.csv": """\
ClePers,LibRisque,Classe,Deb,Fin,Origine
S001,Manutention patients,eleve,2018-04-01,,etude de poste
S002,Poussieres de bois,moyen,2020-01-15,,fiche entreprise
S003,Gestes repetitifs,eleve,2016-09-10,,visite
S004,Charge mentale,a qualifier,2019-11-20,,declaration salarie
""",
    "export_05_biometrie.csv": """\
ClePers,DateExamen,TypeExamen,Resultat,Unite,Interpretation
S001,2024-02-12,IMC,29.4,kg/m2,surpoids
S002,2024-03-18,Audiogramme,25,dB,alteration_legere
S003,2024-05-02,Tension systolique,138,mmHg,limite
S004,2024-06-14,Spirometrie VEMS,82,%,normal
""",
    "export_06_pathologies_atmp.csv": """\
ClePers,DateEvenement,TypeEvenement,CodeCIM10,Pathologie,Reconnu
S001,2023-11-20,ATMP,T92,Sequelle traumatisme membre superieur,non
S002,2022-09-14,MP,M75,TMS epaule,oui
S003,2024-04-02,pathologie,M54,Lombalgie,non
S004,2021-12-05,AT,S62,Fracture main,oui
""",
    "export_07_arrets.csv": """\
ClePers,DateDebutArret,DateFinArret,TypeArret,LieATMP
S001,2024-01-12,2024-02-10,AT,oui
S002,2023-10-01,2023-10-20,maladie,non
S003,2024-02-03,2024-04-30,maladie,non
S004,2024-05-20,2024-06-10,AT,oui
""",
    "export_08_vaccinations.csv": """\
ClePers,Vaccin,DateVaccination,StatutVaccinal,RappelPrevu
S001,DTP,2022-01-15,a_jour,2032-01-15
S002,Hepatite B,2021-06-20,a_jour,
S003,Leptospirose,2023-03-10,rappel_a_prevoir,2025-03-10
S004,DTP,2015-09-12,rappel_a_prevoir,2025-09-12
""",
    "export_09_duerp.csv": """\
CleAdh,Site,UT_Lib,RisqueCollectif,NiveauRisque,MesurePrevention,DateEvaluation
A100,E10,EHPAD - Unite Alzheimer,Manutention patients,eleve,Aide technique leve-personne,2024-01-05
A101,E11,Atelier bois,Poussieres de bois,eleve,Aspiration centralisee,2024-01-12
A100,E10,Bionettoyage,Gestes repetitifs,moyen,Rotation des taches,2024-02-02
A102,E12,Quai livraison,Charge mentale,a qualifier,Organisation du planning,2024-03-15
""",
}

S4_WORDS = ["NomUsuel", "Prenom", "TelPortable", "Adherent", "Siret", "CR"]
S4_VALUES = ["Martin", "Aline", "0600000001", "Clinique", "12345678900011", "Douleurs lombaires"]

COHORTS = {
    "handling_45_plus": {
        "name": "handling_45_plus", "reference_year": 2026,
        "population": {"min_age": 45, "region": "Auvergne-Rhone-Alpes"},
        "criteria": {"exposure_concepts": {"any": ["MANUTENTION_MANUELLE"]}},
    },
    "handling_before_restriction": {
        "name": "handling_before_restriction", "reference_year": 2026,
        "population": {"min_age": 45},
        "longitudinal": {
            "events": {
                "handling": {"table": "exposition_professionnelle", "date_field": "date_debut",
                             "filters": {"exposition_concept_id": {"any": ["MANUTENTION_MANUELLE"]}}},
                "restriction": {"table": "conclusion_medicale", "date_field": "visite_sante_travail.date_visite",
                                "filters": {"restriction_flag": True}},
            },
            "sequences": [{"id": "s", "first": "handling", "then": "restriction", "relation": "before", "min_days": 0}],
        },
    },
    "stop_before_return": {
        "name": "stop_before_return", "reference_year": 2026,
        "population": {"min_age": 45},
        "longitudinal": {
            "events": {
                "stop": {"table": "arret_travail", "date_field": "date_fin", "filters": {"lie_atmp_flag": True}},
                "return": {"table": "visite_sante_travail", "date_field": "date_visite",
                           "filters": {"type_visite_concept_id": "REPRISE"}},
            },
            "sequences": [{"id": "s", "first": "stop", "then": "return", "relation": "before", "min_days": 0, "max_days": 30}],
        },
    },
}


def write_exports(folder, **replaced):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in {**EXPORTS, **replaced}.items():
        (folder / name).write_text(text, encoding="utf-8")
    return folder
