"""Short texts of our own with what the engine makes of them: for tests, and as queries over made tables.

Fixed values: identifiers whose check digits matter.
"""

from __future__ import annotations

#: text, redacted text
REDACTED: list[tuple[str, str]] = [
    ("Fiche ouverte sous le registre national : 85.07.30-033.28 hier.", "Fiche ouverte sous le registre national : [REGISTRE_NATIONAL] hier."),
    ("Le NN 03.02.14-125.46 figure au formulaire.", "Le NN [REGISTRE_NATIONAL] figure au formulaire."),
    ("Son RN 85.13.45-123.45 est mal recopié.", "Son RN [REGISTRE_NATIONAL] est mal recopié."),
    ("Le numéro 85.04.03-123.45 (RN) suit.", "Le numéro [REGISTRE_NATIONAL] (RN) suit."),
    ("NISS 8513451234 illisible.", "NISS [REGISTRE_NATIONAL] illisible."),
    ("Virement sur BE68 5390 0754 7034, merci.", "Virement sur [IBAN], merci."),
    ("Le loyer va sur FR76 3000 4028 1539 4587 1102 345 chaque mois.", "Le loyer va sur [IBAN] chaque mois."),
    ("Facture, TVA BE 0123.456.749, payée.", "Facture, TVA [TVA], payée."),
    ("La cause R.G. n° 31/778/B revient lundi.", "La cause R.G. n° [NUMÉRO_RÔLE] revient lundi."),
    ("Les causes R.G.n°19/567/B et RG : 2018/AB/45, jointes.", "Les causes R.G.n°[NUMÉRO_RÔLE] et RG : [NUMÉRO_RÔLE], jointes."),
    ("Notre réf. : 4471/AB ; votre référence greffe n° 18.22.", "Notre réf. : [RÉFÉRENCE_DOSSIER] ; votre référence greffe n° [RÉFÉRENCE_DOSSIER]."),
    ("La cause RG 18/452 est remise à 9 h 15.", "La cause RG [NUMÉRO_RÔLE] est remise à 9 h 15."),
    ("Numéros du rôle : 8123 et 3 demandes liées.", "Numéros du rôle : [NUMÉRO_RÔLE] et 3 demandes liées."),
    ("La demande, inscrite au rôle général sous le n° 22/901/A, est jointe.", "La demande, inscrite au rôle général sous le n° [NUMÉRO_RÔLE], est jointe."),
    ("Rolnummer\t2019/AR/77 blijft open.", "Rolnummer\t[NUMÉRO_RÔLE] blijft open."),
    ("Farde 17/264/FA au greffe.", "Farde [NUMÉRO_RÔLE] au greffe."),
    ("Le Rép. n° 2019/4410 est clos.", "Le Rép. n° [RÉFÉRENCE_DOSSIER] est clos."),
    ("Le répertoire général n° 2021/77 manque.", "Le répertoire général n° [RÉFÉRENCE_DOSSIER] manque."),
    ("N° Portalis DBVX-V-B7G-NXYZ du jour.", "N° Portalis [RÉFÉRENCE_DOSSIER] du jour."),
    ("Appelez le 0475/12.34.56 demain.", "Appelez le [TÉLÉPHONE] demain."),
    ("Au bureau : (081) 22 33 44.", "Au bureau : [TÉLÉPHONE]."),
    ("Depuis la France +32 (0)4 223 45 68 convient.", "Depuis la France [TÉLÉPHONE] convient."),
    ("Joignable : 0033612345678 le soir.", "Joignable : [TÉLÉPHONE] le soir."),
    ("Le tél.0475 12 34 56 sonne.", "Le tél.[TÉLÉPHONE] sonne."),
    ("GSM\t0475/12.34.56 ou fax 081/22.33.45.", "GSM\t[TÉLÉPHONE] ou fax [TÉLÉPHONE]."),
    ("Elle loue 45 rue de la Gare, 4020 Ville depuis mai.", "Elle loue [ADRESSE] depuis mai."),
    ("Bezoek : Molenstraat 12 bus 3, 9000 Gent.", "Bezoek : [ADRESSE]."),
    ("Rendez-vous Grand-Place 22 samedi.", "Rendez-vous [ADRESSE] samedi."),
    ("Mme M. VERLINDEN, greffière", "Mme [PERSONNE_1], greffière"),
    ("Monsieur le Juge Verhaert entre.", "Monsieur le Juge [PERSONNE_1] entre."),
    ("Les pièces de N. Claessens et de P. Verlinden.", "Les pièces de [PERSONNE_1] et de [PERSONNE_2]."),
    ("Une lettre de R. Claessens est jointe.", "Une lettre de [PERSONNE_1] est jointe."),
    ("L'enfant, née à Huy le 12 avril 2004, témoigne.", "L'enfant, née à [LIEU] le [DATE_NAISSANCE], témoigne."),
    ("Né le 12.04.2004, il signe le 12.04.2004.", "Né le [DATE_NAISSANCE], il signe le 12.04.2004."),
    ("Zorbec VERHAERT, domicilié avenue du Parc 51/3, absent.", "[PERSONNE_1], domicilié [ADRESSE], absent."),
    ("En cause de VERHAERT Luc, appelant.", "En cause de [PERSONNE_1], appelant."),
    ("Vu par l'INP Verhaert, puis par l'avocat général Anne Claessens.", "Vu par l'INP [PERSONNE_1], puis par l'avocat général [PERSONNE_2]."),
    ("Mme CLAESSENS-VERHAERT (Sophie) est entendue.", "Mme [PERSONNE_1] ([PERSONNE_1]) est entendue."),
    ("RAPPORT D'EXPERTISE MÉDICALE", "RAPPORT D'EXPERTISE MÉDICALE"),
    ("PROCÈS-VERBAL D'AUDITION", "PROCÈS-VERBAL D'AUDITION"),
    ("Le véhicule 1-ABC-123 est saisi.", "Le véhicule [PLAQUE] est saisi."),
    ("Un courriel à piece.jointe@exemple.be part.", "Un courriel à [EMAIL] part."),
    ("Écho de 192.168.1.77 au journal.", "Écho de [ADRESSE_IP] au journal."),
    ("Carte 4111 1111 1111 1111 refusée.", "Carte [CARTE_BANCAIRE] refusée."),
    # what stays
    ("Commande 85073003399 expédiée.", "Commande 85073003399 expédiée."),
    ("Prenez la RN 4 puis la RN25.", "Prenez la RN 4 puis la RN25."),
    ("Voyez l'affaire C-694/20 et l'arrêt n° 103/2022.", "Voyez l'affaire C-694/20 et l'arrêt n° 103/2022."),
    ("Reçu le 01.02.2024 10:30, pour 1.234,56 EUR.", "Reçu le 01.02.2024 10:30, pour 1.234,56 EUR."),
    ("Au cours du mois, la somme de 4000 euros fut payée.", "Au cours du mois, la somme de 4000 euros fut payée."),
    ("Madame la Présidente lève la séance.", "Madame la Présidente lève la séance."),
    ("Le code 001234567890 ne sert plus.", "Le code 001234567890 ne sert plus."),
    ("", ""),
]

#: text, the model's span in it, its type, redacted text, reason why the span is kept
DECIDED: list[tuple[str, str, str, str, str]] = [
    ("Le tribunal de première instance de Namur statue.", "Namur", "LOCATION", "Le tribunal de première instance de Namur statue.", ""),
    ("La dame est domiciliée à Namur depuis mai.", "Namur", "LOCATION", "La dame est domiciliée à [LIEU] depuis mai.", ""),
    ("Elle réside chez sa tante, à Ciney, depuis mai.", "Ciney", "LOCATION", "Elle réside chez sa tante, à [LIEU], depuis mai.", ""),
    ("Une foire se tient à Namur en mai.", "Namur", "LOCATION", "Une foire se tient à Namur en mai.", "place"),
    ("Un accord lie la Belgique en mai.", "la Belgique", "LOCATION", "Un accord lie la Belgique en mai.", ""),
    ("Vu par la Cour de cassation en mai.", "la Cour de cassation", "ORGANIZATION", "Vu par la Cour de cassation en mai.", ""),
    ("Livré par Verrerie Dupuis SA en mai.", "Verrerie Dupuis SA", "ORGANIZATION", "Livré par Verrerie Dupuis SA en mai.", "organisation"),
    ("Vu par Verrerie Dupuis SA en mai.", "Verrerie Dupuis SA", "PERSON", "Vu par Verrerie Dupuis SA en mai.", "organisation"),
    ("Selon la méthode Ragon, on divise.", "Ragon", "PERSON", "Selon la méthode Ragon, on divise.", ""),
    ("Le siège est établi à Bouge en mai.", "Bouge", "PERSON", "Le siège est établi à Bouge en mai.", "place"),
    ("Reçu de Lucien VERHAERT ce jour.", "Lucien VERHAERT", "ORGANIZATION", "Reçu de [PERSONNE_1] ce jour.", ""),
    ("Monsieur Verhaert écrit ; plus loin Verhaert répond.", "Verhaert", "ORGANIZATION", "Monsieur [PERSONNE_1] écrit ; plus loin [PERSONNE_1] répond.", ""),
    ("Vu le RG 18/452 en mai.", "RG 18/452", "ORGANIZATION", "Vu le RG [NUMÉRO_RÔLE] en mai.", ""),
    ("Vu l'arrêt ECLI:BE:CASS:2020:ARR.1 en mai.", "ECLI:BE:CASS", "ORGANIZATION", "Vu l'arrêt ECLI:BE:CASS:2020:ARR.1 en mai.", ""),
    ("Reçu de Zorbec\nVandal ce jour.", "Zorbec\nVandal", "PERSON", "Reçu de [PERSONNE_1]\n[PERSONNE_2] ce jour.", ""),
]
