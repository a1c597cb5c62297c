"""The sentences that name_model is fitted on, written for it: names of persons in square brackets, everything else is none."""

# The whole sample, by language.
EXAMPLES = [
    line.strip()
    for line in """
    [Martin Kessler] runs the bakery now.
    [Ottoline Farrow] has been our treasurer since spring.
    Yesterday [Priya Raman] brought the old ledger.
    I spoke with [Bettina Lorch] about the invoice.
    Please send the file to [Tobias].
    Give the spare key to [Hollis Brandt] before lunch.
    We saw [Magda] at the station.
    When [Leonard] arrived, the door was open.
    Because [Isla Morrow] was ill, nobody opened the shop.
    My sister [Ruth] moved to Bristol.
    Our neighbour [Quentin Ashdown] keeps bees.
    Mr [Tennant] refused to sign.
    Mrs. [Adeyemi] will chair the meeting.
    Dr [Sandra Voss] examined the sample.
    Professor [Lindqvist] explained the method again.
    [Edwin]'s bicycle was stolen.
    That was [Nadia Karim]'s idea.
    According to [Philippa Stone], the roof leaks.
    [Carlos] and [Greta] painted the fence.
    The letter was written by [Oren Feldmark].
    Nobody except [Halvard] knew the code.
    Did [Beth] call you back?
    Hello [Simon], how are you?
    Thanks, [Imogen].
    Ask [Doreen] whether the pump works.
    [Jasper Wyndle], who owns the mill, came late.
    The mayor, [Theodora Pike], opened the fair.
    I think [Wilf] is right.
    We heard that [Marguerite Oslo] left in March.
    [Tom] lives in London with his brother [Ben].
    [J. Hartnell] signed the form.
    It was [Ursula B. Crane] on the phone.
    They promoted [Desmond] last week.
    A man called [Rufus] asked for the keys.
    [Anneke van der Meer] teaches physics in Leiden.
    Later [Solveig] took the minutes and [Marek Duda] read them.
    Then [Lydia Thorne] laughed.
    The choir sang for [Winifred].
    The Ashford bridge is closed on Monday.
    We ordered it from the Kelvin catalogue.
    The Marlow station was rebuilt in March.
    Kelvin Ltd delivers on Tuesday.
    She works at Harwick University.
    They live in Berlin near the Spree.
    We drove from Paris to Lyon in June.
    The train to Ashford leaves at nine.
    In London the rent is high.
    Nobody speaks French here.
    Honestly, we had no idea.
    When I started here, there was no lift.
    Gate 3 opens on the long road.
    Ticket QX is about the lights.
    Version B of the report is missing.
    The Mark II engine failed again.
    Our office in Madrid closed in April.
    The Danish team won the cup.
    There was a storm near Bremerton.
    Everyone knows the Tate.
    Down in the valley they use Microsoft Word.
    She studied English and German in Cambridge.
    So what happened with the Olympus camera?
    The Thames was frozen.
    Could you close the window, please?
    Nothing happened on Christmas.
    From my point of view the House of Lords is slow.
    Grace period ends on Friday.
    They promised a Ford van by Easter.
    Google and Siemens sent people.
    Karlsruhe is a pleasant town.
    Bristol has a new bridge.
    Apple presented a new phone.
    Monday was cold.
    Please mark the date.
    Hope is not a plan.
    Rose gardens need water.
    Please bring the Bosch drill.
    [Annette Kröger] leitet jetzt die Werkstatt.
    Gestern hat [Jochen Pfister] die Liste gebracht.
    Ich habe mit [Silke] über den Plan gesprochen.
    Frau [Nowak] kommt erst am Dienstag.
    Herr [Ulrich Sander] hat den Schlüssel.
    Meine Kollegin [Renate] wohnt in Hamburg.
    Das Fahrrad von [Detlef] steht im Hof.
    Wenn [Marlene] anruft, sag Bescheid.
    Ich glaube, dass [Bernd Ahlers] recht hat.
    Danach ging [Roswitha] nach Hause.
    Unser Nachbar [Egon Trautmann] spielt Geige.
    Für [Wiebke] war das neu.
    [Holger] und [Dörte] haben den Zaun gestrichen.
    Frag bitte [Gundula], ob die Pumpe läuft.
    Der Brief ist von [Hartmut Lindner].
    Die Leiterin, [Irmgard Böhm], eröffnete das Fest.
    Können Sie das Fenster schließen?
    Am Ende haben wir den Kühlraum gestrichen.
    Die Kollegen tragen sich in die Liste ein.
    Der Wasserzähler im Keller ist kaputt.
    Es hat drei Versuche gebraucht.
    Im letzten Herbst war die Brücke gesperrt.
    Die Nachtschicht beginnt am Montagmorgen.
    Wir fahren im Juli nach Österreich.
    Der Zug aus München hat Verspätung.
    Niemand wusste, wer für den Schulgarten zuständig ist.
    Das Rathaus in Bremen ist alt.
    Meine Adresse steht im Ausweis.
    Rufen Sie die Werkstatt an.
    Der Bahnhof Altona wird umgebaut.
    Die Firma Bosch liefert am Freitag.
    Zum Glück war der Strom da.
    Gestern Abend fiel die Heizung aus.
    Mit Absicht macht das niemand.
    Wegen Regen fällt das Konzert aus.
    Die Leute sagen, dass Kaffee teuer wird.
    Nach Ostern kommt der Dienstplan.
    [Remedios Lozano] dirige ahora la tienda.
    Ayer [Íñigo] trajo el libro.
    Hablé con [Maite Urrutia] del presupuesto.
    La señora [Quiroga] llegó tarde.
    Mi hermana [Lourdes] vive en Sevilla.
    Creo que [Gonzalo] tiene razón.
    El coche de [Amparo] está roto.
    Cuando [Jimena] llamó, ya era tarde.
    Pregunta a [Rodrigo Salas] si funciona.
    [Nuria] y [Santi] pintaron la valla.
    El alcalde, [Evaristo Pons], abrió la feria.
    Los compañeros pusieron el horario en el mercado.
    En mi opinión, el formulario cuesta mucho.
    Tendríamos que mirar el puente de Toledo.
    Nadie quería ir a Valencia en agosto.
    La empresa Repsol no contestó.
    Hicieron falta tres intentos.
    En Madrid hace calor.
    El Museo del Prado abre el lunes.
    [Sylvain Morel] dirige la boulangerie.
    Hier [Aurélie] a apporté le cahier.
    J'ai parlé avec [Thibault Garnier] du budget.
    Madame [Lefebvre] arrivera mardi.
    Ma sœur [Solène] habite à Lyon.
    Je crois que [Gaspard] a raison.
    La voiture de [Mireille] est en panne.
    Quand [Odile] est arrivée, la porte était ouverte.
    [Bastien] et [Noémie] ont peint la clôture.
    Demande à [Fabrice] si la pompe marche.
    Nous sommes allés à Marseille en juin.
    La société Renault ne répond pas.
    Personne ne parle anglais ici.
    Le pont de Nantes est fermé.
    Les Français aiment le fromage.
    À mon avis, le projet coûte trop cher.
    [Ornella Fabbri] dirige il negozio.
    Ieri [Tiziano] ha portato il libro.
    Ho parlato con [Ilaria Conti] del bilancio.
    La signora [Bellini] arriva martedì.
    Mia sorella [Serena] abita a Torino.
    Credo che [Fabio] abbia ragione.
    La macchina di [Mirella] è rotta.
    [Dario] e [Loredana] hanno dipinto il cancello.
    Siamo andati a Roma in luglio.
    La ditta Olivetti non risponde.
    Nessuno parla inglese qui.
    Il ponte di Verona è chiuso.
    [Leonor Tavares] dirige a loja.
    Ontem o [Duarte] trouxe o livro.
    Falei com a [Filipa Moura] sobre o orçamento.
    A senhora [Queirós] chega na terça.
    Acho que o [Rui] tem razão.
    O carro da [Graça] avariou.
    Fomos a Lisboa em julho.
    A empresa Galp não responde.
    A ponte de Coimbra está fechada.
    [Femke Dijkstra] leidt nu de winkel.
    Gisteren bracht [Sjoerd] het boek.
    Ik sprak met [Marloes Bakker] over de begroting.
    Mevrouw [Hoekstra] komt dinsdag.
    Mijn zus [Anouk] woont in Utrecht.
    Ik denk dat [Joris] gelijk heeft.
    De fiets van [Wouter] staat buiten.
    We gingen in juli naar Antwerpen.
    Het bedrijf Philips antwoordt niet.
    De brug bij Zwolle is dicht.
    Niemand spreekt hier Engels.
    [Gunilla Sjöberg] leder nu butiken.
    Igår kom [Torbjörn] med boken.
    Jag pratade med [Ebba Nyström] om budgeten.
    Fru [Hedlund] kommer på tisdag.
    Min syster [Linnea] bor i Malmö.
    Jag tror att [Rasmus] har rätt.
    Vi åkte till Uppsala i juli.
    Företaget Volvo svarar inte.
    Bron vid Gävle är stängd.
    [Birthe Kjeldsen] leder nu butikken.
    I går kom [Troels] med bogen.
    Jeg talte med [Lone Mikkelsen] om budgettet.
    Min søster [Pernille] bor i Aarhus.
    Jeg tror, at [Asger] har ret.
    Vi tog til Odense i juli.
    Firmaet Carlsberg svarer ikke.
    [Bożena Kowalczyk] prowadzi teraz sklep.
    Wczoraj [Zbigniew] przyniósł książkę.
    Rozmawiałem z [Haliną Wójcik] o budżecie.
    Pani [Mazur] przyjdzie we wtorek.
    Moja siostra [Grażyna] mieszka w Poznaniu.
    Myślę, że [Leszek] ma rację.
    W lipcu pojechaliśmy do Gdańska.
    Firma Orlen nie odpowiada.
    Most w Toruniu jest zamknięty.
    [Людмила Орлова] теперь руководит магазином.
    Вчера [Геннадий] принёс книгу.
    Я говорил с [Тамарой Беловой] о бюджете.
    Моя сестра [Вера] живёт в Казани.
    Я думаю, что [Аркадий] прав.
    В июле мы поехали в Самару.
    Фирма Газпром не отвечает.
    Мост в Твери закрыт.
    Call [Bob] and say that [Jack] is late.
    [Grace] fixed the pump, not [Mark].
    Tell [Rose] the van is here.
    Ask [Dale] or [Heath].
    Without [Osric] we are lost.
    Have you seen [Thandiwe]?
    We could not find [Aldous Reeve].
    [Elspeth]'s sister sells honey.
    [Nkechi] understood the joke.
    Even [Barnaby] liked the soup.
    Why did [Corin] leave early?
    I know [Saskia] from school.
    Everyone listened to [Hester].
    The medal went to [Ignatius Bell].
    She married [Lucian Frey] in Rome.
    It belongs to [Petronella].
    Remember what [Anselm] wrote.
    The Canon printer is broken.
    Please pass the Stanley knife by Friday.
    We crossed the Danube and the Rhine.
    Everything stopped during the Falklands war.
    The road through Ambleside is closed.
    Return the Hitachi drill to the shed.
    We looked at the Parthenon and the Acropolis.
    What a fine view of the Matterhorn!
    The Victoria line is delayed.
    Wi-Fi and Bluetooth are off.
    Hast du [Ingo] getroffen?
    Ohne [Gesine] wird das nichts.
    [Annegret] kocht die Suppe.
    [Hinnerk] baut ein Boot.
    Die Karte kam von [Wilfried Osten].
    Doktor [Behrens] rät zur Ruhe.
    Vorhin kam [Elfriede Maas] vorbei.
    Kennst du [Torben]?
    Nur [Swantje] hat es gemerkt.
    Ich kaufe Brot und Käse.
    Sie verkaufen auch Tee und Gebäck.
    Hast du Hunger?
    Hast du Werkzeug dabei?
    Ohne Strom geht das Licht nicht.
    Der Fluss fließt durch Dresden.
    Kennst du Leipzig?
    Das Wetter bleibt bei Nebel schlecht.
    Fenster putzen die Kinder nicht.
    Wasser steht im Keller.
    Vorhin kam Post an.
    Nur Geduld hilft hier.
    Die Karte kam von Norden.
    Kaffee und Kuchen gibt es um drei.
    Ich brauche Zeit, Geld und Hilfe.
    ¿Has visto a [Eulalia]?
    No veo a [Anselmo].
    Vi a [Dolores Freire] en el parque.
    El río Tajo pasa por Aranjuez.
    Se fueron a Cádiz.
    El monte Teide está nevado.
    ¿Viste la película?
    La alcaldía de Murcia está cerrada.
    Vimos el Alcázar y la Giralda.
    As-tu trouvé [Ghislain] ?
    Je ne vois pas [Apolline].
    Selon [Firmin], il pleut.
    C'est [Honorine Blanc] qui chante.
    La mairie de Rennes est ouverte.
    Le fleuve traverse Orléans.
    Le train passe par Dijon.
    As-tu lu le journal ?
    Nous avons vu le Louvre et la Seine.
    Hai visto [Gaetano]?
    Non vedo [Domitilla].
    Conosci [Ermanno Villa]?
    Il treno passa per Bologna.
    Hai visto il film?
    Abbiamo visto il Colosseo e il Tevere.
    Viu o [Anselmo]?
    Não encontro a [Eduarda].
    Conheces o [Vasco Leitão]?
    O rio atravessa Braga.
    O comboio passa por Aveiro.
    Viste o filme?
    Vimos o Douro e a Torre.
    Heb je [Thijs] gevonden?
    Ik zie [Roelien] niet.
    Ken je [Gerrit Postma]?
    De trein rijdt door Arnhem.
    Heb je de krant gelezen?
    We zagen de Maas en de Dom.
    Har du träffat [Ragnhild]?
    Jag ser inte [Sixten].
    Känner du [Alfhild Berg]?
    Tåget går genom Skövde.
    Har du läst tidningen?
    Vi såg Vasa och Globen.
    Har du mødt [Preben]?
    Jeg kan ikke se [Gudrun].
    Kender du [Valdemar Holm]?
    Toget kører gennem Vejle.
    Har du læst avisen?
    Widziałaś [Kazimierza]?
    Nie widzę [Bronisławy].
    Znasz [Teofila Barana]?
    Pociąg jedzie przez Opole.
    Czytałeś gazetę?
    Wisła płynie przez Sandomierz.
    Ты встретил [Глеба]?
    Я не вижу [Ульяны].
    Ты знаешь [Фёдора Гусева]?
    Поезд идёт через Калугу.
    Волга течёт через Саратов.
    Ты читал газету?
    What a clear view of Mount Snowdon!
    The people of Malaga complain.
    [Dinah Crowe] and [Felton Ames] run a shop.
    [Beatrix] and [Cyril] share a flat.
    Los vecinos de Huesca celebran.
    El río Duero creció en mayo.
    La mairie de Nancy est fermée.
    Les habitants de Pau attendent.
    Il fiume attraversa Pisa.
    Gli abitanti di Lucca aspettano.
    Il fiume Arno è basso.
    Doktor [Lünemann] empfiehlt mehr Ruhe.
    Según [Leocadia], llueve.
    Er wünscht uns mehr Glück.
    Est-ce que tu viens demain ?
    Qu'est-ce que c'est ?
    Y a-t-il du pain ?
    По-моему, это слишком дорого.
    Во-первых, нет времени.
    Medarbejderne kom for sent.
    Grannarna kom för sent.
    Varje vecka regnar det.
    Hver uge regner det.
    Naboerne flyttede bordet.
    Соседи пришли поздно.
    Sąsiedzi przyszli późno.
    Gæsterne stillede bordet tilbage.
    Eleverne fandt nøglen.
    Gästerna ställde fram bordet.
    [Rosamund] grüßt den Bäcker.
    [Eberhard] kauft das Brot für die Feier.
    Is it [Ewan] who keeps the keys?
    It was [Delphine] who found him.
    Neither [Piers] nor [Maud Ellery] came.
    Either [Joachim] or [Elin] will drive.
    [Siobhan] cannot drive.
    [Eoin] never complains.
    [Thea] might come later.
    Nobody cooks like [Cosmo].
    He is older than [Ottilie].
    Between [Clement] and me there is no quarrel.
    The kettle is [Ingram]'s.
    The farmer from Totnes sold up.
    The nurse in Penrith knows.
    A shop near Keswick sells it.
    Between Dover and Hastings it rained.
    The Weser floods every spring.
    Mr [Gray] knows the way.
    Mrs [Hill] sings on Sundays.
    Niemand kocht so gut wie [Wendelin].
    Er ist älter als [Ottmar].
    Warum lacht [Hedwig]?
    Am Apparat ist [Traudel Fuchs].
    Der Lehrer heißt [Gernot Weiland].
    Weder [Sönke] noch [Maren] kam.
    Im Schrank liegen Teller, Tassen und Löffel.
    Auf dem Tisch stehen Gläser, Salz und Pfeffer.
    Unser Verein sucht Spieler.
    Die Gemeinde braucht Freiwillige.
    Der Laden verkauft Schuhe.
    Er ist schneller als Wasser.
    Warum lacht Publikum?
    Nadie cocina como [Leandro].
    Es mayor que [Ramiro].
    La profesora se llama [Casilda Mora].
    Ni [Blas] ni [Inmaculada] vinieron.
    El tren llega de Lugo.
    El barco va de Vigo a Gijón.
    Nadie vive en Soria.
    Personne ne cuisine comme [Léopold].
    Il est plus grand que [Barnabé].
    La dame s'appelle [Eugénie Roche].
    Ni [Alban] ni [Garance] ne sont venus.
    Le train part de Caen.
    Il vient de Lille.
    Nessuno cucina come [Fulvio].
    È più alto di [Saverio].
    La signora si chiama [Ginevra Costa].
    Né [Corrado] né [Nives] sono venuti.
    Il treno parte da Modena.
    Viene da Trieste.
    Ninguém cozinha como o [Zeferino].
    É mais alto que [Valdemar].
    A senhora chama-se [Iolanda Cruz].
    O comboio sai de Évora.
    Niemand kookt zoals [Evert].
    Hij is groter dan [Teun].
    De dame heet [Wilhelmina Kok].
    Noch [Sjors] noch [Maaike] kwam.
    De trein vertrekt uit Deventer.
    Hij komt uit Assen.
    Ingen lagar mat som [Folke].
    Han är längre än [Yngve].
    Damen heter [Margareta Ek].
    Varken [Signe] eller [Elof] kom.
    Tåget går från Kiruna.
    Ingen laver mad som [Ejnar].
    Han er højere end [Villy].
    Damen hedder [Bodil Ravn].
    Hverken [Dagny] eller [Svend] kom.
    Toget kører fra Horsens.
    Nikt nie gotuje jak [Ireneusz].
    Jest wyższy niż [Bogusław].
    Pani nazywa się [Lucyna Wrona].
    Ani [Hubert], ani [Zofia] nie przyszli.
    Pociąg jedzie ze Szczecinka.
    Pochodzi z Radomia.
    Никто не готовит как [Прохор].
    Он выше чем [Егор].
    Её зовут [Клавдия Зайцева].
    Ни [Макар], ни [Дарья] не пришли.
    Поезд идёт из Омска.
    Он приехал из Твери.
    Сегодня поёт [Антонина Рябова].
    Dziś śpiewa [Halina Dudek].
    Idag spelar [Ulla Strand].
    I dag spiller [Inger Toft].
    Vandaag speelt [Geertje Smit].
    Hoje toca o [Belmiro Lopes].
    Oggi suona [Nunzia Greco].
    Aujourd'hui joue [Blandine Petit].
    Hoy toca [Encarna Vidal].
    Heute spielt [Irmtraud Lange].
    Vedremmo domani. Potremmo uscire. Forse piove. Giovedì siamo chiusi. Finalmente arriva la posta. Quanti ne vuoi? Abbiamo finito. Servono viti. Passami il sale. Tornano presto.
    Deberíamos salir. Quizás llueva. Necesitamos tornillos. Pásame la sal. Vuelven pronto. Hacía frío. Trabajan mucho. Volvieron tarde. Queremos pan. Ojalá funcione.
    Devrions-nous partir ? Peut-être pleut-il. Passez le sel. Voici les clés. Dehors il neige. Reviens vite. Toutes les lampes brûlent. Attendons ici. Heureusement tout marche. Pourquoi rient-ils ?
    Deveríamos sair. Talvez chova. Precisamos de pregos. Voltam cedo. Fazia frio. Felizmente funciona. Queremos pão. Trabalham muito. Passa o sal. Porque riem eles?
    Misschien regent het. Vanmiddag komt de post. Gelukkig werkt alles. Bussen rijden niet. Geef het zout. Morgenochtend begint het. Waarom lachen ze? Buiten sneeuwt het. Kranten liggen hier. Zouden we gaan?
    Kanske regnar det. Tidningen ligger här. Tåget kom sent. Skolan är stängd. Hoppas det går bra. Imorse snöade det. Varför skrattar de? Ute är det kallt. Flickan sjunger. Lyckligtvis fungerar allt.
    Måske regner det. Avisen ligger her. Toget kom sent. Skolen er lukket. Håber det går. Udenfor sner det. Hvorfor griner de? Pigen synger. Heldigvis virker alt. Skibet sejlede.
    Może pada. Gazeta leży tutaj. Pociąg się spóźnił. Szkoła jest zamknięta. Dlaczego się śmieją? Dziewczyna śpiewa. Powinniśmy wyjść. Wszystko działa. Podaj sól. Statek odpłynął.
    Может быть, дождь. Газета лежит здесь. Автобус опоздал. Школа закрыта. Почему они смеются? Девушка поёт. Думаю, всё работает. Передай соль. Корабль ушёл. Возьмём хлеб. Хочется спать.
    Vielleicht regnet es. Draußen schneit es. Hoffentlich klappt das. Warum lachen alle? Züge fahren nicht. Uhren ticken. Kinder singen. Wir sammeln alte Uhren. Sie sucht Arbeit. Man braucht Mut. Äpfel und Birnen liegen im Korb. Alte Möbel stehen da.
    Perhaps it rains. Several lamps broke. Somewhere a dog barked. Buses run late. Apples fell. Should we go? Outside it snows. Luckily everything works. Whatever happens, we stay. Repairs take time.
    [Osbert] loathes cheese.
    [Ivor] collects stamps.
    [Mabel] sleeps.
    Nobody likes [Clive] much.
    Everybody trusts [Enid].
    [Karla Brook] teaches dance.
    [Peter Wood] paints boats.
    [Lucía Campos] pinta barcos.
    [Rosa Flores] enseña danza.
    [Hans Bauer] malt Boote.
    [Nils Ström] målar båtar.
    [Anders Skov] maler både.
    [Jan Smit] schildert boten.
    [Paolo Monti] dipinge barche.
    [Luís Ribeiro] pinta barcos.
    [Jean Moulin] peint des bateaux.
    [Ewa Lis] maluje łodzie.
    [Павел Волков] рисует лодки.
    [Elisa] duerme mucho.
    [Orla] sover länge.
    [Filippa] sover længe.
    [Guus] slaapt lang.
    [Ettore] dorme molto.
    [Inácio] dorme muito.
    [Lucienne] dort beaucoup.
    [Ryszarda] śpi długo.
    [Нина] спит долго.
    [Edeltraud] schläft lange.
    The shop at Skipton burned down.
    A fire at Whitby destroyed the pier.
    They met at Ripon.
    L'autobus per Lecce è pieno.
    Il treno per Siena parte.
    L'aereo da Palermo è in ritardo.
    Автобус до Тулы полон.
    Самолёт из Сочи опоздал.
    Bussen till Umeå är full.
    Bussen til Ribe er fuld.
    De bus naar Breda is vol.
    Autobus do Kielc jest pełny.
    El autobús a Jaén está lleno.
    Le bus pour Reims est plein.
    O autocarro para Faro está cheio.
    Der Bus nach Celle ist voll.
    Nobody believes [Leopold] these days.
    Everyone trusts [Winnie] by now.
    [Gwen] and [Toby Marsh] are twins.
    [Nora] und [Felix Wolf] sind Zwillinge.
    [Gudula Kraus] liest alte Bücher.
    [Heiner Kamp] verkauft alte Autos.
    Jeg tror, at [Trine] snart er her.
    Jag vet att [Moa] snart är här.
    Я надеюсь, что [Алла] скоро придёт.
    Надеемся, что [Пётр Жуков] придёт.
    Кажется, идёт дождь.
    Автобус до Орла полон.
    Дорога до Пензы длинная.
    Was it [Jemima] who rang?
    Was it really a mistake?
    Neither [Edgar] nor [Vita] came.
    Neither Leeds nor York won.
    Im Schrank liegen Hemden, Hosen und Socken.
    Unser Chor sucht Sänger.
    Unsere Schule sucht Lehrer.
    Wir sind stolz auf [Alwine].
    Alle hören auf [Burkhard].
    Wij zijn trots op [Gijs].
    Iedereen rekent op [Lieke de Wit].
    Vi är stolta på [Runa].
    Alla litar på [Einar].
    Vi er stolte af [Signe].
    Alle stoler på [Keld].
    Liczymy na [Teodora].
    Wszyscy patrzą na [Kingę].
    Мы ругаем [Захара].
    Я слышу [Игната].
    Sento [Tullio].
    Chiamo [Erminia].
    J'écoute [Gontran].
    J'appelle [Ysaline].
    Confiamos no [Hermes].
    Gosto da [Idália].
    Confío en [Plácido].
    I hope [Ingmar] wins.
    I guess [Lorna] forgot.
    I wish [Noor] luck.
    [Denton Ross] found a coin on the beach.
    [Cassia Bloom] broke her arm on the ice.
    [Rufina Gold] lost her hat in the wind.
    [Ansel Crow] drank the milk.
    De weg naar Hoorn is lang.
    Vägen till Mora är lång.
    Vejen til Kolding er lang.
    La strada per Cuneo è lunga.
    La carretera de Cuenca es larga.
    A estrada de Beja é longa.
    La route de Sète est longue.
    Droga do Płocka jest długa.
    Die Straße nach Husum ist lang.
    Wir warten auf Regen.
    Er hofft auf Glück.
    Sie zeigt auf Karten.
    Wir treffen uns neben der Garage noch einmal.
    Das Rad steht vor der Theke und rostet.
    Die Kiste liegt unter der Plane noch immer.
    Hinter dem Schuppen noch ein Baum.
    Neben der Mensa gibt es Kaffee.
    Wir sehen uns in der Pause oder auf dem Flur.
    Er wohnt über der Bäckerei und neben dem Kino.
    Mit der Leiter kommt man auf das Dach.
    Ich habe den Schlüssel, die Karte und das Buch.
    Escríbame a la tarde. Avíseme luego. Espéreme aquí. Dígame algo. Búsqueme mañana.
    Das Buch von [Elfi] fehlt.
    Das Rad von [Hauke] quietscht.
    Droga do Torunia jest sucha.
    Autobus do Sopotu jest pusty.
    """.splitlines()
    if line.strip()
]
