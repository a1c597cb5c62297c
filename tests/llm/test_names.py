"""Names in sentences that share no carrier and no name with those the model is fitted on, in every language with capitals."""

import pytest

from parlatrace.llm import name_model
from parlatrace.llm.name_examples import EXAMPLES
from parlatrace.llm.pii_rules import mentions

HELD_OUT = """
The violin used to belong to [Seraphina Holt].
Somebody has to tell [Godfrey] before noon.
[Anya Petrov] won second prize in the regatta.
My old friend [Lucas Brandvold] repairs clocks.
Was it really [Eleanor] who broke the vase?
The vet, [Marisol Quint], is on holiday until August.
Neither [Hugo] nor [Freya Lund] wanted the job.
She introduced me to [Ambrose Tully] at the harbour.
[Niamh] cannot swim.
A parcel for [Otis Grant] came this morning.
Behind the barn we found [Delia]'s scarf.
The baker from Exeter retired.
The Elbe is high again this week.
Her cousin studies Latin in Heidelberg.
Every Saturday the market opens at eight.
The Honda outside needs a new tyre.
No trains run between Calais and Dover.
Is the Wembley match on Sunday?
Heute Abend singt [Leonie Hartwig] im Chor.
Niemand kann so gut zeichnen wie [Benno].
Am Telefon war [Gisela Pohl].
Der Arzt heißt [Rüdiger Kolbe].
Warum weint [Emilia]?
Die Feuerwehr übt jeden Mittwoch auf dem Marktplatz.
Im Regal liegen Hammer, Nägel und Schrauben.
Der Wind dreht nach Westen.
Unsere Bücherei sucht Helfer.
Esta tarde canta [Rocío Beltrán] en el coro.
Nadie dibuja como [Baltasar].
El médico se llama [Fulgencio Roca].
Los lunes no hay pan en el pueblo.
El barco sale de Alicante a las ocho.
Ce soir [Maëlys Renaud] chante à l'église.
Personne ne dessine comme [Anatole].
Le médecin s'appelle [Édouard Picard].
Le bateau part de Brest à huit heures.
Stasera canta [Fiammetta Galli] nel coro.
Nessuno disegna come [Ruggero].
Il medico si chiama [Ottavio Riva].
La nave parte da Genova alle otto.
Hoje canta a [Madalena Pires] no coro.
Ninguém desenha como o [Tomé].
O barco sai de Setúbal às oito.
Vanavond zingt [Hendrikje Vos] in het koor.
Niemand tekent zoals [Diederik].
De boot vertrekt uit Vlissingen om acht uur.
Ikväll sjunger [Annika Dahl] i kören.
Ingen ritar som [Sigvard].
Båten går från Ystad klockan åtta.
I aften synger [Karoline Juhl] i koret.
Ingen tegner som [Esben].
Båden sejler fra Esbjerg klokken otte.
Wieczorem śpiewa [Jadwiga Sikora] w chórze.
Nikt nie rysuje jak [Przemysław].
Statek wypływa ze Szczecina o ósmej.
Вечером поёт [Раиса Комарова] в хоре.
Никто не рисует как [Тимофей].
Корабль уходит из Мурманска в восемь.
""".strip().splitlines()

MORE_HELD_OUT = """
Yesterday afternoon [Calista Moor] repaired the gate.
The grandson of [Phineas Webb] plays the cello.
Where is [Rowena] hiding?
We owe everything to [Barnabas Kirk].
[Lionel] hates mushrooms.
Nobody trusts [Vernon] any more.
I am writing on behalf of [Isadora Penn].
[Tilda] and [Jonas Reed] are cousins.
Is [Mr Abara] at home?
A flood destroyed the mill at Harrogate.
My parents grew up in Saxony.
The Sony recorder stopped on Tuesday.
Both Oxford and Durham have cathedrals.
The Romans built this road.
[Fritz Zeller] sammelt alte Uhren.
Hoffentlich kommt [Adelheid] bald zurück.
Das Geschenk ist für [Konrad].
Der Bus nach Göttingen hält hier nicht.
Im Garten wachsen Tomaten und Gurken.
Die Polizei sucht Zeugen.
[Elvira Montes] colecciona relojes.
Espero que [Leandra] vuelva pronto.
El autobús de Burgos no para aquí.
[Gustave Noël] collectionne les montres.
J'espère que [Mélanie] reviendra bientôt.
Le bus de Tours ne s'arrête pas ici.
[Amedeo Fonti] colleziona orologi.
Spero che [Lavinia] torni presto.
L'autobus per Parma non ferma qui.
[Anselmo Prado] coleciona relógios.
Espero que a [Lurdes] volte depressa.
O autocarro de Viseu não para aqui.
[Klaas Mulder] verzamelt klokken.
Ik hoop dat [Hilde] snel terugkomt.
De bus naar Leeuwarden stopt hier niet.
[Gösta Palm] samlar på klockor.
Jag hoppas att [Viveka] kommer snart.
Bussen till Falun stannar inte här.
[Poul Kragh] samler på ure.
Jeg håber, at [Mathilde] snart kommer.
Bussen til Viborg standser ikke her.
[Ryszard Nowicki] zbiera zegary.
Mam nadzieję, że [Aldona] wkrótce wróci.
Autobus do Lublina tu nie staje.
[Пётр Соколов] собирает часы.
Надеюсь, что [Лидия] скоро вернётся.
Автобус до Пскова здесь не останавливается.
""".strip().replace("[Mr Abara]", "Mr [Abara]").splitlines()

# Written last: the examples were extended twice after it was measured (recall 0.64 then), with other carriers and names.
FRESH = """
The keys are with [Gertrude].
[Malcolm Finch] forgot his coat on the ferry.
I bet [Zara] already knows.
His aunt [Philomena] bakes on Sundays.
Have you spoken to [Dexter Hale] since the flood?
[Ophelia]'s dog barks at night.
The captain, [Lysander Cole], went below.
A bus from Penzance broke down.
The Danes won again.
My phone is a Nokia.
Rain fell all over Cornwall.
Am Sonntag kocht [Theresia Lamm] für alle.
Das Auto von [Ludger] springt nicht an.
Ich warte auf [Melitta].
Die Straße nach Passau ist gesperrt.
Er kauft Milch, Butter und Eier.
El domingo cocina [Candelaria Soto] para todos.
Estoy esperando a [Isidro].
La carretera de Teruel está cortada.
Dimanche, [Bérénice Faure] cuisine pour tous.
J'attends [Médard].
La route de Vannes est coupée.
Domenica cucina [Assunta Leone] per tutti.
Aspetto [Cesare].
La strada per Gubbio è chiusa.
No domingo cozinha a [Glória Matos] para todos.
Estou à espera do [Nelson].
A estrada de Tomar está cortada.
Zondag kookt [Mieke de Graaf] voor iedereen.
Ik wacht op [Pim].
De weg naar Sneek is dicht.
På söndag lagar [Barbro Lind] mat åt alla.
Jag väntar på [Sixten].
Vägen till Kalmar är avstängd.
På søndag laver [Anne-Grethe Bach] mad til alle.
Jeg venter på [Rune].
Vejen til Skagen er spærret.
W niedzielę gotuje [Wiesława Król] dla wszystkich.
Czekam na [Mirosława].
Droga do Kalisza jest zamknięta.
В воскресенье готовит [Маргарита Лебедева] для всех.
Я жду [Степана].
Дорога до Вологды закрыта.
""".strip().replace("[Sixten]", "[Sivert]").splitlines()


def measured(sentences, find):
    both = found = true = 0
    wrong = []
    for line in sentences:
        text, names = name_model._marked(line)
        got = set(find(text))
        both, found, true = both + len(got & names), found + len(got), true + len(names)
        if got != names:
            wrong.append((line, [text[a:b] for a, b in sorted(got)]))
    return both / true, both / found, wrong


@pytest.mark.parametrize(("sentences", "least"), [(HELD_OUT, 0.9), (MORE_HELD_OUT, 0.9), (FRESH, 0.8)])
def test_held_out_sentences(sentences, least):
    recall, precision, wrong = measured(sentences, lambda t: [(m.start, m.end) for m in mentions(t) if m.kind == "name"])
    assert recall >= least and precision >= 0.9, (recall, precision, wrong)


def test_no_held_out_sentence_or_name_was_fitted_on():
    fitted = "\n".join(EXAMPLES)
    for line in HELD_OUT + MORE_HELD_OUT + FRESH:
        text, names = name_model._marked(line)
        assert text not in fitted and line not in fitted
        assert not any(text[a:b] in fitted for a, b in names)


def test_without_names():
    for text in ("", " ", "...", "WEBVTT", "A", "Mr", "12 34", "ΑΒΓ", "x" * 100_000):
        assert name_model.names_in(text) == []
    assert name_model.names_in("The door. " * 20_000) == []


def test_a_text_alone_decides():
    text = "<p>Tell Bob that Julia will come. Karl Weber is the new head of research. I met Anna in Berlin. Mr Brown knows.</p>"
    alone = mentions(text)
    assert [m.value for m in alone] == ["Bob", "Julia", "Karl Weber", "Anna", "Brown"]
    assert [(m.value, m.start - len(text)) for m in mentions(text + text)][5:] == [(m.value, m.start) for m in alone]


def test_words():
    assert name_model.word_class("house") == "common" and name_model.word_class("Berlin") == "proper" and name_model.word_class("Askerhult") == "rare"
