"""The small labelled table of the personal-information model.

Sentences in the style of postings, with marked items; slots are filled with invented values in many spellings. The table
is made from the templates and a fixed seed, so it is the same at every run: `rows()` gives (text, spans).
"""

from __future__ import annotations

import random

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
_SLOT = {"E": "email", "P": "phone", "I": "id_number", "A": "street_address", "F": "street_address", "N": "person_name"}

#: {N} person, {E} mail, {P} phone, {I} identity number, {A} street address; {c} company, {t} town, {w} product, {d} digits, {n} small number, {k} noun.
TEMPLATES = """
Kontakt: {N}, {E}, Tel. {P}.
Kontakt: {N}, Telefon {P}, E-Mail {E}
Fragen beantwortet {N} gern per E-Mail an {E}.
Bei Fragen hilft dir {N} aus dem Recruiting weiter.
Ihre Ansprechperson ist {N}, erreichbar unter {P}.
Ihr Ansprechpartner: {N}, {A}
Das Team von {N} freut sich auf dich.
Das Team von {N} freut sich auf dich. {x}
Vorstellungsgespräche führen {N} und {N}.
Vorstellungsgespräche führen {N} und {N}. {x}
Schreib an {E} oder {E}, wir melden uns. {x}
Our office: {A}. {x}
Die Betriebsrätin {N} erreichen Sie unter {E}.
Die Betriebsrätin {N} erreichen Sie unter {P}.
Bewerbung bitte an {E}.
Bewerbung bitte an {E}. {x}
Schreib an {E} oder {E}, wir melden uns.
Vorab per WhatsApp an {P}, danach Unterlagen an {E} oder per Post: {A}.
Ruf kurz durch: {P} oder mobil {P}
Rückfragen: {P}
Rückfragen: {P} {x}
Interner Vermerk: {N}, {I}, bitte nicht veröffentlichen.
Übernommen aus Akte {N}, {I}, wohnhaft {A}.
Vertretung hinterlegt ({I}).
Vertretung hinterlegt ({I}). {x}
Vertretung hinterlegt ({I}). {x} {x}
File copied from {I}.
File copied from {N}, {I}, living at {A}.
Internal note, do not publish: {N}, {I}.
Notatka wewnętrzna: {N}, {I}, nie publikować.
Unterlagen senden Sie an {A}.
Unterlagen senden Sie an {A}. {x}
Einsatzort ist {A}.
Einsatzort ist {A}. {x}
Sie finden uns hier: {A}, Eingang im Hof, Anmeldung bei {N}.
Your contact is {N}, phone {P}.
Questions? Call {N} on {P}.
Reach us at {P} or {E}.
Send your CV to {E} and mention when you could start.
Write to {E} or visit us at {A}.
Visit us at {A}. {x}
Votre contact : {N}, téléphone {P}.
Pour toute question, {N} vous répondra.
Envoyez votre dossier à {E}.
Nos bureaux se trouvent ici : {A}.
Nos bureaux se trouvent ici : {F}.
Nos bureaux se trouvent ici : {F}. {x}
Votre lieu de travail : {F}. {x}
Vragen kun je stellen aan {N} via {E}.
Stuur je brief naar {E}.
Bel {N} op {P}.
Bel gerust met {N}, nummer {P}.
Bel gerust met {N}, nummer {P}. {x}
{N} leads the team.
{N} leads the team in {t}. {x}
{N} leitet das Team. {x}
Herzliche Grüße, {N}
Ons adres is {A}.
Pytania prosimy kierować do: {N}, tel. {P}.
Zgłoszenia prosimy wysyłać na adres {E}.
Biuro mieści się pod adresem {A}.
Biuro mieści się pod adresem {A}. {x}
Ruf kurz durch: {P} oder mobil {P} {x}
Ruf an unter {P} oder mobil {P}. {x}
Erreichbar unter {P} oder mobil {P}, auch am Samstag.
Ihre Ansprechperson ist {N}, erreichbar unter {P}. {x}
Vorab per WhatsApp an {P}, danach Unterlagen an {E} oder per Post: {A}. {x}
File copied from {I}. {x}
File copied from {I}. {x} {x}
Internal note, do not publish: {N}, {I}. {x}
Notatka wewnętrzna: {N}, {I}. {x}
Ausweis hinterlegt: {I}. {x}
On file: {I}. {x}
Übernommen aus Akte {N}, {I}, wohnhaft {A}. {x}
{N}, wohnhaft {A}. {x}
Sie finden uns hier: {A}, Eingang im Hof, Anmeldung bei {N}. {x}
Unsere Adresse: {A}. {x}
Questions? Call {N} on {P}. {x}
Your contact is {N}, phone {P}. {x}
Write to {E} or visit us at {A}. {x}
""".strip().splitlines()

#: Sentences without personal items, many of them close to one.
PLAIN = """
Seit {y} arbeitet {c} mit rund {d} Beschäftigten in der Gastronomie.
{c} betreut {d} Kunden in der {k}.
{c} wächst weiter, deshalb besetzen wir zum Quartalsbeginn eine Stelle als {k}.
Hinter {w} steht ein eingespieltes Team aus {t}.
Bewerbungsschluss ist der {date}, Aktenzeichen {ref}.
Kennziffer: {ref}.
Bitte geben Sie die Ref.-Nr. {ref} an.
Reference: {ref}.
Please quote job number {long} in your letter.
Advert no. {ref} was published in {y}.
Unser Postfach {dd} {dd} {dd} wird täglich geleert.
Wir arbeiten nach DIN EN ISO 9001:2015 und DIN {d}-{n}.
We are certified to ISO {d}:2015 and audited every {n} months.
Eingetragen unter HRB {d} beim Registergericht.
USt-IdNr. der Firma: DE{long}.
Die Haltestelle {s} liegt direkt am Werkstor {n}, Halle {n}.
Unser Lager in der {s} wird gerade umgebaut.
Our site is next to the stop at {er}, gate {n}.
Shifts run from 0600 to 1430 or from 1400 to 2230.
Die Schichten liegen zwischen 06:00 und 14:30 Uhr.
Die Eingruppierung erfolgt nach EG {n}, die Schichten liegen zwischen {n}:00 und {n}:30.
Im Haus Lenora betreuen wir {d} Bewohner.
Folgen Sie uns unter @{h}_karriere oder auf www.{h}.example/jobs.
Follow @{h}_jobs or visit www.{h}.example/careers.
Mehr auf https://{h}.example/stellen/{d}
Die Daten der Vorgängerin wurden entfernt: [PHONE REDACTED].
Former contact: [EMAIL REDACTED].
Ansprechpartner: [NAME REDACTED], Tel. [PHONE REDACTED].
Mehr als {n} Standorte, aber kurze Wege: so arbeitet {c}.
Pro Monat fallen etwa {d} Vorgänge in der {k} an.
Gemeinsam mit der {k} bereiten Sie {d} Einsätze vor.
Die Vergütung beginnt bei 44.000 Euro jährlich.
Gehalt: ab 3 270 Euro, im Monat.
Die Prämie für empfohlene Kolleginnen beträgt 1.565 € einmalig.
Jährlich bewegen wir 29.329 Paletten mit einem Budget von {n} Mio. €.
We manage a budget of {n} million EUR and ship 99,652 parcels a year.
Ihr Einstieg liegt bei mindestens 3.920,00 EUR brutto pro Monat.
Das Angebot: 27,25 EUR je Std., je nach Erfahrung auch mehr.
Wir sind ein Unternehmen aus dem Handwerk mit Sitz in {t} und suchen ab sofort Verstärkung.
Idealerweise kennst du dich mit {w} aus oder willst es lernen.
In der {k} arbeiten Sie täglich mit {w} und Excel.
Sie kennen die {k} und haben schon mit {w} gearbeitet.
Unsere {k} und unsere {k} arbeiten seit {n} Jahren mit {w} {n}.
Mindestens {n} Monate Praxis mit Python erleichtern den Einstieg.
Kenntnisse in {w} sind von Vorteil, aber kein Muss.
Wer Tourenplanung, {k} oder {w} kennt, startet schneller.
Nach {n} Wochen folgt eine Schulung in {k} oder {w}.
Über den Fortgang informiert Sie die {k} innerhalb von {n} Tagen.
Die Stelle gehört zur {k} und ist ab sofort frei.
Wir bieten einen sicheren Arbeitsplatz, Urlaubsgeld und ein hilfsbereites Team.
Freuen Sie sich auf 30 Tage Urlaub und einen Zuschuss zum Nahverkehr.
Dazu kommen betriebliche Altersvorsorge sowie eine gründliche Einarbeitung.
Zu Ihren Aufgaben gehört die Pflege der Stammdaten sowie die Betreuung unserer Bestandskunden.
Klingt das gut, dann melde dich einfach bei uns.
Wir freuen uns auf Ihre Bewerbung über unser Portal.
Bei uns zählt der Mensch, nicht nur der Lebenslauf.
Das Büro liegt wenige Minuten vom Bahnhof entfernt.
Die {k} in {t} sucht nach Absprache Unterstützung.
Kommen Sie zu uns und gestalten Sie mit einem Schichtteam den Alltag in der Logistik.
Für unser Team in {t} suchen wir dich als {k}.
Die Stelle ist zunächst auf {n} Monate befristet.
Bitte nennen Sie uns Ihren frühesten Eintrittstermin.
Gefragt sind CNC-Fräsen, Node.js, SQL und Key Account Management.
Join our growing team in {t} as a Product Owner.
{c} has been around since {y} and employs about {d} people.
At {c} you will find short decision paths and honest feedback.
Our internal tooling reviews have been running on {w} for {n} years.
You have seen supply audits before and know {w} Pro or something like it.
You will hear from us within {n} days.
At least {n} months of practice with TypeScript would help you to settle in.
Experience with {w} is a plus, not a must.
Anyone familiar with {w}, fleet records or SAP will settle in faster.
About {d} cases a month in branch reviews will land on your desk.
The salary is 4,480 € monthly at the lower end.
There is a monthly travel allowance of 50 EUR.
We look forward to hearing from you.
Depuis {y}, {c} accompagne ses clients dans toute la région.
Notre entreprise cherche une personne motivée pour rejoindre le site de {t}.
Chaque mois, environ {d} dossiers concernent la gestion du matériel.
Vous gérez les stocks avec le logiciel {w} {n}.
Sinds {y} werkt {c} aan slimme oplossingen voor klanten in de hele regio.
Voor onze vestiging in {t} zoeken wij een collega die graag aanpakt.
Je houdt je bezig met facturen in het systeem {w} {n}.
Elke maand komen er ongeveer {d} aanvragen binnen.
Od roku {y} firma {c} obsługuje klientów w całym regionie.
Do naszego zakładu w miejscowości {t} szukamy osoby chętnej do pracy.
Praca z systemem {w} oraz kontrola magazynu nie jest ci obca.
Anzeigen-Nr. {long}. {x}
Anzeigen-Nr. {long}.
Ray {d}
Prüfnummer {long}. {x}
Vorgang {d} {x}
Request ID: {d}
HTTP Status 503 – Service Unavailable
undefined undefined undefined
Bitte warten, Ihr Browser wird überprüft. Ray {d}
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Abschnitt 1: Text. Abschnitt 2: Text. Abschnitt 3: Text.
Jetzt bewerben Merken Teilen Drucken Melden
After {n} weeks there is a course on network reviews or {w}.
Behind {w} there is a friendly team in {t}.
Behind {w} {n} there is a growing team in {t}.
Solliciteer via onze website, dan nemen wij snel contact met je op.
Het contract loopt eerst {n} maanden en kan worden verlengd.
Je hebt ervaring met Führung en je leert snel bij. Kennis van {w} is mooi meegenomen, maar niet verplicht.
Daarnaast houd je je bezig met het plannen van de ritten.
Wij bieden een vast contract na een half jaar en een goede reiskostenvergoeding.
Au quotidien, vous assurez la coordination avec les fournisseurs.
Selon les besoins, vous prenez aussi en charge la rédaction des rapports.
Vous connaissez la gestion du matériel ou vous souhaitez apprendre. La maîtrise de {w} est un plus.
Nous recrutons pour notre équipe un poste de Comptable.
Nous vous offrons des tickets repas ainsi que une formation continue.
Le contrat est prévu pour {n} mois et peut être prolongé.
Twoją rolą jest też aktualizacja grafików. Co miesiąc trafia do nas około {d} spraw, a wśród nich analiza faktur.
W razie potrzeby dochodzi także prowadzenie dokumentacji.
Każdego dnia czeka na ciebie obsługa maszyn na hali wraz z zespołem.
Poszukujemy pracownika na stanowisko Magazynier.
Oferujemy szkolenia wewnętrzne oraz dofinansowanie do posiłków.
Umowa jest zawierana na {n} miesięcy z możliwością przedłużenia. Wyślij zgłoszenie przez naszą stronę.
Znajomość {w} będzie dodatkowym atutem.
Unser Alltag dreht sich um {w}, Kommunikation und AWS.
Für die Stelle zählen Treasury, 3D-Konstruktion, Rust und {w}.
Gefragt sind Airflow, MongoDB, 3D-Konstruktion und Rust.
We look for C++, Go, {w} and SAP.
The role calls for Teamfähigkeit, Spark and Power BI.
You will often work with Barista, React, {w} and English.
In this role you work on supply migration with {w} Pro and Java every day.
You own the topic from the first idea to daily operation.
Außerdem erhältst du kostenfreie Getränke. Wichtig sind uns Neugier und ein freundliches Auftreten.
Schwerbehinderte Menschen werden bei gleicher Eignung bevorzugt berücksichtigt.
Applications from people of all backgrounds are welcome.
Sie bringen ein Studium mit technischem Schwerpunkt mit und haben Erfahrung mit {w} und Tableau.
Du baust die {k} für {w} auf und dokumentierst die {k}.
Unsere {k} in {t} wächst. Eine eigene {k}, einen Zuschuss zum Nahverkehr und kostenfreie Getränke gehören dazu.
Ein Auge für die {k} hilft ebenso wie Neugier.
Sie pflegen die Fehlerseiten 404 und 500 unseres Webshops und prüfen, ob JavaScript aktiv ist.
Erfahrung mit Templates, Platzhaltern und Serienbriefen ist hilfreich.
Nach der Einarbeitung koordinieren Sie eigenständig die Planung und Steuerung laufender Aufträge.
Wir, {c}, sind ein Familienbetrieb aus {t}.
Unser Betrieb {c} in {t} bildet aus.
P.O. Box {d}, {t}
Postfach {dd} {dd} {dd}, {long} {t}
Unser Alltag dreht sich um {l}.
Unser Alltag dreht sich um {l}. {x}
Für die Stelle zählen {l}.
Für die Stelle zählen {l}. {x}
Gefragt sind {l}.
Gefragt sind {l}. {x}
Gefragt sind {l2}, {l2} und {l3}.
Gefragt sind {l2}, {l2} und {l3}. {x}
Unser Alltag dreht sich um {l2}, {l2} und {l3}. {x}
Für die Stelle zählen {l2} und {l3}.
We look for {l2}, {l2} and {l3}. {x}
We look for {l}.
The role calls for {l}.
You will often work with {l}. {x}
Wer {l2}, {k} oder {w} kennt, startet schneller.
Sie bringen eine handwerkliche Ausbildung mit und haben Erfahrung mit {l2} und {l2}.
Kenntnisse in {l2} sind von Vorteil, aber kein Muss.
Experience with {l2} is a plus, not a must.
You have a solid grounding in the trade and know your way around {l2} and {l2}.
In der {k} arbeiten Sie täglich mit {w} und {l2}.
Vous avez déjà travaillé avec {l2} et vous aimez apprendre.
Masz doświadczenie w obszarze {l2} i szybko się uczysz.
Wir bieten {b}, {b} und ein kleines Team.
Freuen Sie sich auf {b} und {b}.
Eine eigene {k}, {b} und {b} gehören dazu.
In der {k} gibt es {b}. Außerdem erhältst du {b}.
Dazu kommen {b} sowie eine gründliche Einarbeitung.
{c} sucht zum Herbst eine Stelle als {j}.
Join our distributed team in {t} as a {j}.
For our site in {t} we need someone who likes to get things done.
Wij zijn op zoek naar een {j} voor ons team.
Das Angebot: {money} im Monat, je nach Erfahrung auch mehr.
Das Angebot: {money} Euro p. a., je nach Erfahrung auch mehr.
Compensation: from {money}, monthly. {x}
Pay starts at {money} p.a.. {x}
Wir zahlen ab {money} pro Stunde. {x}
Gehalt: ab {money}, im Jahr. {x}
You set up network dashboards for {w} and write down what you learn. {x}
After {n} weeks there is a course on yearly quality planning or {w} {n}.
Zajmujesz się tym, czym jest archiwizacja transportu w systemie {w}.
After {n} weeks there is a course on {ek} or {w}.
After {n} weeks there is a course on {ek} or {w}. {x}
Our {ek} and {ek} have been running on {w} for {n} years.
You have seen {ek} before and know {w} or something like it.
{c} serves {d} clients and takes care of their {ek}. {x}
Anyone familiar with {l2}, {ek} or {w} will settle in faster.
Some understanding of {ek} is needed, the rest we will teach you.
We are a friendly company in energy and we are hiring in {t}. {x}
The position belongs to {ek} and is open right away. Please apply through our website.
There is also a bike scheme for everyone in {ek}. You can expect paid overtime, flexible hours and a quiet office.
Znasz zagadnienia takie jak {l2} i {l2}.
Znasz zagadnienia takie jak przygotowanie transportu i planowanie szkoleń. {x}
Une première expérience avec {l2} serait appréciée.
Too many requests. Slow down and retry after 429 seconds.
Wer {l2}, {k} oder {w} kennt, startet schneller. {x}
Grundlagen der {k} sind nötig, {k} lernen Sie bei uns.
Hinter {w} steht ein hilfsbereites Kollegium aus {t}.
Kennziffer: 0{d}-{y}-{d}. {x}
Access denied. You don't have permission to view this page. Reference #{d}
Bitte versuchen Sie es später erneut. Vorgang {d}
test test test asdf asdf {d}
Die Schulung zum Thema Blindtext und Satz findet in unserer Druckerei statt.
Oczekujemy dokładności, cierpliwości i dobrej organizacji pracy. {x}
We value curiosity and good listening skills. {x}
We value a sense of humour and a calm manner.
Je krijgt ook flexibele werktijden vanaf de eerste dag. Je hebt al eens gewerkt aan het beheer van voertuigen.
Um fortzufahren, bestätigen Sie bitte, dass Sie kein Roboter sind.
You make sure that our 404 pages and cookie banners work even when JavaScript is disabled.
404 – Seite nicht gefunden.
Your day starts with a short meeting, after which you review incoming deliveries.
Die gewünschte Anzeige {d} existiert nicht mehr oder wurde verschoben. Zurück zur Startseite.
Wir verwenden Cookies, um Inhalte zu personalisieren. Alle akzeptieren Nur notwendige Einstellungen Datenschutz Impressum
Vous prenez aussi en charge la rédaction des rapports hebdomadaires avec vos collègues.
Join our growing team in {t} as a Mechanical Designer. {c} serves {d} clients.
Poszukujemy pracownika na stanowisko Specjalista ds. obsługi klienta. {x}
Do twoich zadań należy wsparcie nowych pracowników oraz kontakt z dostawcami.
Your salary: $XX,XXX.
Dear %FIRSTNAME%, we would love to meet you.
Zum Lesen der Anzeige bitte einloggen oder kostenlos registrieren.
Sie bringen eine Ausbildung mit und haben Erfahrung mit Computer Vision und Agile Methoden.
Internal Server Error (500). The server encountered an error.
Gateway timeout while fetching upstream content (502).
Traceback: KeyError 'description' at render step {d}
Entschuldigung, da ist etwas schiefgelaufen. Fehlercode: {d}-500
Ihre Aufgaben: - Aufgabe 1 - Aufgabe 2 - Aufgabe 3 {x}
Dies ist ein Blindtext. An ihm wird gezeigt, wie die Schrift wirkt, bevor der richtige Inhalt da ist. Blindtext Nummer {d}.
Die XYZ GmbH (Name ergänzen) bietet Ihnen viel.
Sie erhalten einen Fahrtkostenzuschuss von bis zu 50 € monatlich. {x}
Wichtig sind uns Sorgfalt und Belastbarkeit. Sicheres Deutsch in Wort und Schrift setzen wir voraus. {x}
Fehler 404: Der Server konnte Ihre Anfrage nicht verarbeiten.
Template nicht gefunden: job_detail_{d}.tpl
Als {{JOB_TITLE}} unterstützen Sie unser Team in {t}.
You write test plans and translate customer wishes into small tasks. {x}
You coordinate vendors across several sites and train new colleagues on the line.
Together with people from other departments you plan releases and review designs. {x}
In this role you answer tickets, keep the wiki up to date and help with the weekly stocktaking.
You prepare offers for long-standing clients and look after them from first call to invoice.
You build and test new features with a small crew and write down what you learn. {x}
From time to time you also translate requirements for other teams and take over on-call duty.
You maintain machines, check incoming goods and report faults to the shift lead. {x}
You will plan routes, coordinate drivers and take part in audits across several branches.
Od pierwszego dnia otrzymasz prywatną opiekę medyczną oraz elastyczne godziny pracy.
Oferujemy stabilne zatrudnienie, kartę sportową i prywatną opiekę dla całej rodziny. {x}
Do twoich zadań należy obsługa klientów, przygotowanie dokumentów i kontrola jakości.
Vous bénéficiez dès le premier jour d'une mutuelle et de horaires souples. {x}
Vous assurez le suivi des commandes et vous formez les nouveaux collègues.
Je werkt nauw samen met andere afdelingen en je leidt nieuwe mensen op. {x}
Je krijgt een goed salaris, vrije dagen en een fiets van de zaak.
Sie schreiben Angebote, betreuen langjährige Kunden und schulen neue Kolleginnen und Kollegen. {x}
Du prüfst eingehende Ware, meldest Störungen und hältst unsere Unterlagen aktuell. {x}
Du arbeitest eng mit anderen Abteilungen zusammen und übersetzt Anforderungen in kleine Schritte.
Unsere Benefits: #BENEFIT_1#, #BENEFIT_2#. {x}
Stand: TT.MM.JJJJ, Unternehmen: Musterfirma GmbH. {x}
Wer Führerschein C, {k} oder {w} kennt, startet schneller.
Gefragt sind Führerschein C, {l2} und Führerschein B.
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. {x}
In ruhigen Wochen bleibt Zeit, Unterlagen zu ordnen und Neues zu lernen. {x}
Sie nehmen Aufträge entgegen, und in ruhigen Zeiten verbessern Sie mit uns die Abläufe.
Die Steuerung laufender Projekte liegt in Ihrer Zuständigkeit. In stillen Wochen bleibt Zeit für Weiterbildung.
Benefits: TEXT_PLACEHOLDER. we value patience and honest feedback. {x}
""".strip().splitlines()

_FIRST = "Anna Jonas Mirela Tobias Svenja Luca Bao Tarik Oksana Emre Zoe Ilka Falk Thea Piet Ole Hanno Nadja Veit Amira Marek Elif Sören Katharina Yusuf Ingrid Pavel Chloé Wout Agnieszka".split()
_SKILLS = "Treasury;Embedded C;RTOS;Computer Vision;PyTorch;NLP;Teamfähigkeit;Kommunikation;Zuverlässigkeit;Problemlösung;Führung;Lean Management;Six Sigma;Spring Boot;Node.js;R;Git;Docker;AWS;Rust;Go;C++;C#;.NET;Helm;Verkauf;Empfang;Sanitärtechnik;Pflege;Medikamentengabe;Buchhaltung;DATEV;Steuerrecht;Lohnabrechnung;Revision;Controlling;Excel;Power BI;Tableau;SAP;CAD;3D-Konstruktion;FEM-Simulation;Toleranzanalyse;CNC-Fräsen;SPS-Programmierung;Feldbus;Hydraulik;Pneumatik;Schweißen;Löten;Lackieren;Kochen;Barista;Housekeeping;Unterrichten;Beratung;Inklusion;Key Account Management;Telefonakquise;Social Media;Grafikdesign;Videoschnitt;Englisch;Scrum;Agile Methoden;Erste Hilfe;Laboranalytik;Vue;Angular;React;dbt;pandas;NumPy;Jenkins;Kafka;Airflow;Spark;Snowflake;Ansible;Terraform;Kubernetes;Linux;FMEA;Azure;SQL;Java;Python;TypeScript;Texten;Anästhesie;Wundversorgung;Elektroinstallation;Holzbearbeitung;Kinderbetreuung;Zollabwicklung;Staplerschein;Disposition;Lagerwirtschaft;Präsentationstechnik;Statistik;Geriatrie;SEO;CRM".split(";")
_PERKS = "ein Diensträder-Programm;gemeinsame Sommerfeste;flexible Arbeitszeiten;kostenfreie Getränke;Urlaubsgeld;betriebliche Altersvorsorge;30 Tage Urlaub;einen Zuschuss zum Nahverkehr;regelmäßige Fortbildungen;ein Gesundheitsbudget;einen sicheren Arbeitsplatz;mobiles Arbeiten an zwei Tagen".split(";")
_ADJECTIVES = "legacy mobile yearly shared regional two-shift low-noise paperless technical seasonal cross-border internal automated preventive weekly".split()
_AREAS = "training network ward billing safety vendor machine supply customer tooling payroll fleet energy warehouse claims".split()
_WORKS = "forecasts handovers reviews documentation scheduling onboarding calibration planning inspections workflows audits support cost-control dashboards".split()
_POSTS = "Data Engineer;Product Owner;Softwareentwickler (w/m/d);Buchhalterin;Magazijnmedewerker;Finance Analyst;Customer Success Manager;Operator maszyn;Sachbearbeiterin Einkauf;Shift Supervisor;Site Reliability Engineer;Verpleegkundige;Schweißer - m/w/d".split(";")
_STREETS = "Garten Mühlen Linden Rosen Hafen Schul Bahnhof Wiesen Kanal Speicher Torf Kiesel Kranich Lerchen Salz Wall Sonnen Birken Kirch Ring".split()
_ENDS = "straße straße strasse weg gasse allee ufer platz ring damm markt steig str. str. pfad hof".split()
_OWN = ["Hinter dem Wall", "Neuer Markt", "Am Alten Hafen", "Platz der Brücken", "Alte Postallee", "Kleine Twiete", "An der Mole", "Zum Steinbruch", "Unter den Eichen", "Im Winkel", "Auf dem Sande", "Große Bleiche"]
_ENGLISH = ["Harbour Road", "Canal Road", "Mill Lane", "Station Street", "Station St", "Bridge Avenue", "Orchard Close"]
_FRENCH = ["impasse des Tilleuls", "avenue des Tilleuls", "rue du Moulin", "boulevard des Forges", "place de la Gare", "chemin des Vignes"]
_DUTCH = ["Molenweg", "Lindelaan", "Kerkstraat", "Havenkade", "Molenstraat", "Lindenweg"]
_SUFFIX = ["", "", "", "", "a", "b", " c", "a", "-20"]
_POLISH = ["ul. Lipowa", "ul. Polna", "al. Parkowa", "ul. Kolejowa", "os. Leśne"]
_DIGITS = ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun")
_SYLLABLES = "ber tol mar ken ul dra fu pal sen wi gro lan ster mo ri ha vel zan kru quen ost im bra del tra nyk ow ett sky lun dorf moor wald berg mann".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self, least: int = 2, most: int = 3) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(least, most)))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def last(self) -> str:
        w = self.word().capitalize()
        return f"{w}-{self.word().capitalize()}" if self.r.random() < 0.12 else w

    def first(self) -> str:
        return self.r.choice(_FIRST) if self.r.random() < 0.6 else self.word(1, 2).capitalize()

    def name(self) -> str:
        r, f, n = self.r, self.first(), self.last()
        form = r.random()
        if form < 0.4:
            s = f"{f} {n}"
        elif form < 0.5:
            s = f"{f[0]}. {n}"
        elif form < 0.57:
            s = f"{f} {r.choice('ABEMT')}. {n}"
        elif form < 0.69:
            s = f"{n}, {f}"
        else:
            title = r.choice(["Herr", "Frau", "Herrn", "Frau", "Hr.", "Fr.", "Ms.", "Mr", "Mrs.", "Mr.", "Dr.", "Prof. Dr.", "Dipl.-Ing.", "Frau Dr.", "Herrn Dr.", "Pan", "Pani", "Mme", "M.", "mevrouw", "dhr."])
            s = f"{title} {n}" if r.random() < 0.45 else f"{title} {f} {n}"
        case = r.random()
        return s.upper() if case < 0.06 else s.lower() if case < 0.12 and "." not in s else s

    def town(self) -> str:
        return self.r.choice(["", "", "", "Bad "]) + self.word(1, 2).capitalize() + self.r.choice(["hausen", "stadt", "dorf", "münde", "brück", "loh", "heim"]) + self.r.choice([""] * 6 + [" an der Tessel", " (Murne)"])

    def street(self) -> str:
        r = self.r
        x = r.random()
        if x < 0.2:
            return r.choice(_OWN)
        s = r.choice(_STREETS) if r.random() < 0.7 else self.word(1, 2).capitalize()
        e = r.choice(_ENDS)
        return f"{s}-{e.capitalize()}" if r.random() < 0.08 else f"{s} {e.capitalize()}" if r.random() < 0.08 else s + e

    def address(self) -> str:
        r, n = self.r, self.r.randint(1, 199)
        x = r.random()
        if x < 0.06:
            return self.french()
        if x < 0.16:
            return r.choice(["", "", f"Unit {r.randint(1, 9)}, ", f"Flat {r.randint(1, 30)}, "]) + f"{n}{r.choice(_SUFFIX)} {r.choice(_ENGLISH)}" + r.choice(["", f", {self.town()}"])
        number = str(n) + r.choice([""] * 5 + ["a", "a", " b", "c", f"-{self.digits(3)}", f"-{self.digits(3)}", f"/{r.randint(1, 9)}"])
        s = r.choice(_DUTCH) if x < 0.22 else r.choice(_POLISH) if x < 0.28 else self.street()
        space = "" if s.endswith("str.") and r.random() < 0.3 else " "
        zipped = f"{self.digits(5)} {self.town()}"
        return f"{s}{space}{number}" + r.choice(["", "", "", "", f", {zipped}", f" | {zipped}", f" – {zipped}", f" in {zipped}", f", {self.town()}", f" in {self.town()}"])

    def french(self) -> str:
        r = self.r
        zipped = f"{self.digits(5)} {self.town()}"
        return f"{r.randint(1, 199)}{r.choice(_SUFFIX)}{r.choice([', ', ', ', ' '])}{r.choice(_FRENCH)}" + r.choice(["", "", f", {self.town()}", f" – {zipped}", f", {zipped}"])

    def mail(self) -> str:
        r = self.r
        local = r.choice([f"{self.first()}.{self.word()}", f"{self.word()}_{self.digits(2)}", f"{self.first()}+bewerbung{self.digits(2)}", f"{self.word()}", r.choice(["jobs", "personal", "karriere", "recruiting", "bewerbung", "people", "hr-team", "kontakt.hr", "info"])]).lower()
        domain = [*r.choice([[], [], [], ["hr"], ["mail"], ["post"]]), "-".join(self.word(1, 2) for _ in range(r.randint(1, 3))) + r.choice(["", "", "", "-kg", "-se", "-e-v", "-gmbh"]), *r.choice([["example"], ["test"], ["invalid"], ["example", "org"], ["example", "com"], ["de"], ["example", "net"]])]
        at = r.choice(["@"] * 9 + ["&#64;", "(at)", "[at]", "{at}", " at ", " at ", " at ", " (ät) ", " @ ", " @ ", "＠", " [at] ", " (at) "])
        dot = r.choice([" dot ", " punkt ", "."]) if at.strip() not in ("@", "＠", "&#64;") else "."
        s = r.choice([""] * 14 + ["mailto:"]) + local + at + dot.join(domain)
        return s.upper() if r.random() < 0.05 else s

    def phone(self) -> str:
        r = self.r
        area = r.choice(["89", "30", "40", "221", "69", "171", "172", "176", "1632", "7" + self.digits(3)])
        rest = self.digits(r.randint(6, 8))
        if r.random() < 0.12:  # written without any sign
            return f"0{area}{rest}"
        if r.random() < 0.05:
            return " ".join(_DIGITS[int(d)] for d in "0" + area + rest)
        if r.random() < 0.06:
            return r.choice([f"(202) 555-{self.digits(4)}", f"+1 202-555-{self.digits(4)}", f"+1 (202) 555 {self.digits(4)}"])
        sep = r.choice(["", " ", " ", "-", "/", " / ", ".", " – ", " "])
        country = r.choice(["", "", "", "+49", "+49", "0049", "+44", "+48", "+33", "+31"])
        if country:
            head = r.choice([f"{country}{area}", f"{country} {area}", f"{country} (0){area}", f"{country} (0) {area}", f"{country}-{area}", f"{country}{sep}{area}"])
        else:
            head = r.choice([f"0{area}", f"(0{area})", f"0{area}"])
        step = r.choice([2, 3, 4, 9, 9])
        groups = [rest[i : i + step] for i in range(0, len(rest), step)]
        inner = sep if sep in (" ", ".", "-", " – ") else r.choice(["", " ", "-", " "])
        s = r.choice([""] * 15 + ["tel:"]) + head + (sep or ("" if step == 9 else " ")) + inner.join(groups)
        return "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in s[:4]) + s[4:] if r.random() < 0.06 else s

    def identity(self) -> str:
        r, d = self.r, self.digits
        up = lambda n: "".join(r.choice("ABCDEFGHKLMNPRTUVXYZ0123456789") for _ in range(n))
        card = up(9) if r.random() < 0.6 else f"{up(3)} {up(3)} {up(3)}"
        tax = r.choice([d(11), f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(2)}/{d(3)}/{d(3)}/{d(3)}"])
        soc = r.choice([f"{d(8)}{r.choice('ABCDEKLMS')}{d(3)}", f"{d(2)} {d(6)} {r.choice('ABCDEKLMS')} {d(3)}", f"{d(2)}-{d(6)}-{r.choice('ABCDEKLMS')}-{d(3)}"])
        ahv = f"756.{d(4)}.{d(4)}.{d(2)}"
        return r.choice([
            f"{r.choice(['Steuer-ID', 'Steuer-ID', 'IdNr.', 'St.-IdNr', 'Steueridentifikationsnummer:', 'Steuer-Nr.', 'tax ID', 'Tax number'])} {tax}",
            f"{r.choice(['Sozialversicherungsnr.', 'Versicherungsnummer', 'SVNR', 'RV-Nr.:', 'Sozialversicherungsnummer', 'SV-Nummer'])} {soc}",
            f"{r.choice(['AHV', 'AHV-Nr.', 'AHV-Nr.', ''])} {ahv}".strip(),
            f"{r.choice(['PESEL', 'PESEL:', 'PESEL'])} {d(11)}",
            f"{r.choice(['Personalausweis', 'Ausweis-Nr.', 'Reisepass Nr.', 'passport no.', 'Passport No', 'Personalausweisnummer', 'ID card no.', 'ID card', 'PA-Nr', 'Pass-Nr.'])} {card}",
            f"{r.choice(['Personalausweis', 'Ausweis-Nr.', 'Reisepass Nr.', 'passport no.', 'ID card', 'PA-Nr'])} {card}",
            f"{r.choice(['BSN', 'BSN:', 'NIR', 'Social security number', 'National Insurance number'])} {d(9)}",
        ])

    def company(self) -> str:
        r, w = self.r, self.word().capitalize()
        return r.choice([f"{w} {r.choice(['Pflege', 'Bau', 'Robotics', 'Personal', 'Energie', 'Handel', 'Klinik', 'Media'])} {r.choice(['GmbH', 'AG', 'KG', 'SE', 'e. V.', 'GmbH & Co. KG'])}", f"{w} & {r.choice(['Partner', 'Söhne', 'Cie.', 'Sohn', self.word().capitalize()])} {r.choice(['AG', 'GmbH', 'KG', 'SE', 'e. V.'])}"])

    def product(self) -> str:
        w = self.word()
        return self.r.choice([w.capitalize(), w.upper(), f"{w.capitalize()}OS", f"{w.capitalize()} Pro", f"{w.capitalize()}-{self.digits(3)}", f"{w.capitalize()} {self.r.randint(1, 9)}"])

    def other(self, key: str) -> str:
        r = self.r
        return {
            "c": self.company, "t": self.town, "w": self.product, "d": lambda: self.digits(r.randint(2, 5)).lstrip("0") or "7", "n": lambda: str(r.randint(1, 40)), "y": lambda: str(r.randint(1950, 2018)), "dd": lambda: self.digits(2),
            "k": lambda: r.choice(["Reise", "Kunden", "Netz", "Lager", "Vertrags", "Anlagen", "Personal", "Stations"]) + r.choice(["planung", "wartung", "logistik", "prüfung", "erfassung", "beratung"]),
            "date": lambda: f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.2023", "ref": lambda: r.choice([f"{self.digits(4)}-{self.digits(5)}-{self.digits(2)}", f"{self.digits(3)}.{self.digits(2)}-{self.digits(5)}", self.digits(6), f"{self.digits(5)}-{self.digits(4)}-{self.digits(4)}"]), "long": lambda: self.digits(r.randint(9, 11)),
            "l": lambda: ", ".join(r.sample(_SKILLS, r.randint(2, 4))) + r.choice([" und ", " and ", " und "]) + r.choice(_SKILLS), "l2": lambda: r.choice(_SKILLS), "l3": lambda: r.choice([x for x in _SKILLS if " " in x]), "b": lambda: r.choice(_PERKS), "j": lambda: r.choice(_POSTS),
            "money": lambda: r.choice(["38.000", "38.000,00", "7,490", "50,000", "3 270", "44'000.00", "27,25", "29.45", "5.393", "£31,500.00", "£22,45", "$61,000"]) + r.choice(["", " €", " EUR", " Euro", " USD", " Kč", " euros", " Zloty", " zł", " Franken", " Fr.", " Tsd. €", " Pfund", " Kronen"]) + r.choice(["", "", " monatlich", " mtl.", " jährlich", " Jahresbrutto", " am Tag"]),
            "ek": lambda: f"{r.choice(_ADJECTIVES)} {r.choice(_AREAS)} {r.choice(_WORKS)}",
            "s": self.street, "er": lambda: r.choice(_ENGLISH), "h": lambda: f"{self.word()}-{self.word(1, 2)}{r.choice(['-ag', '-kg', '-se', '-e-v', ''])}", "x": self.plain,
        }[key]()

    def plain(self) -> str:
        return self.fill(self.r.choice(PLAIN))[0]

    def fill(self, template: str) -> tuple[str, list[tuple[int, int, str]]]:
        import re

        out, spans, last = "", [], 0
        for m in re.finditer(r"(?<!\{)\{(\w+)\}(?!\})", template):
            out += template[last : m.start()]
            last = m.end()
            if m[1] in _SLOT:
                text = {"E": self.mail, "P": self.phone, "I": self.identity, "A": self.address, "F": self.french, "N": self.name}[m[1]]()
                spans.append((len(out), len(out) + len(text), _SLOT[m[1]]))
                out += text
            else:
                out += self.other(m[1])
        return out + template[last:], spans


def rows(copies: int = 15, plain: int = 8, seed: int = 20) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled lines: each template `copies` times among plain sentences, each plain sentence `plain` times."""
    maker = _Maker(seed)
    out = []
    for template in TEMPLATES * copies:
        text, spans = maker.fill(template)
        before = maker.plain() + " " if maker.r.random() < 0.4 else maker.r.choice(["", "", "• ", "- "])
        after = " " + maker.plain() if maker.r.random() < 0.4 else ""
        if maker.r.random() < 0.03:
            text = text.upper()
        out.append((before + text + after, [(a + len(before), b + len(before), k) for a, b, k in spans]))
    for template in PLAIN * plain:
        out.append((maker.fill(template)[0], []))
    maker.r.shuffle(out)
    return out
