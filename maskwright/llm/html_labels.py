"""The labelled table of the text-block classifier: small pages in fragments, each marked 1 if its blocks are main text.

Twelve layouts are filled with text of four languages. Class names are neutral in most of them, and misleading in some;
articles hold short paragraphs, lists of links and quotations, and adverts and comments can be as long as paragraphs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

#: A page: (html fragment, 1 for main text) in page order.
Page = list[tuple[str, int]]


@dataclass(frozen=True)
class Words:
    """Text of one language."""

    lang: str
    title: str
    long: tuple[str, ...]
    short: tuple[str, ...]
    items: tuple[str, ...]
    menu: tuple[str, ...]
    advert: tuple[str, ...]
    comment: tuple[str, ...]
    notice: str
    footer: str
    form: str
    more: tuple[str, ...]


ENGLISH = Words(
    "en",
    "Council decides on the old bridge",
    (
        "Several hundred people came to the square this morning to hear what the council had decided about the old bridge over the river.",
        "Most of them stayed until noon, because the discussion went on longer than the mayor, who had another meeting, had planned for it.",
        "The bridge has been closed since the flood of last spring took its middle away, and nobody knows yet what a new one would cost.",
        "An engineer from the capital measured both banks in May and wrote a report of sixty pages, which the council read in two nights.",
    ),
    ("Then it rained.", "Nobody spoke.", "Not yet, at least.", "That was all.", "The vote comes in June."),
    ("Bread", "Water and two apples", "A map of the valley", "Good shoes"),
    ("Home", "World news", "Money", "Sport", "Weather", "About us"),
    (
        "Buy two pairs of shoes today and get the third one free.",
        "Our mattress is the best mattress, and it is cheaper this week than ever before. Order it now from your sofa, and sleep on it tomorrow night.",
    ),
    (
        "Well said!",
        "I have lived by the river for forty years and have never seen such a mess as the one that this council has made of a simple thing.",
        "Thank you for writing it all down, my mother will like it.",
    ),
    "We use cookies to make this site work and to count how many people read each page.",
    "2020 The Daily Paper. All rights reserved, reprints only with written permission of the publisher.",
    "Sign up for our letter and get the best stories of the week.",
    ("Snow in April", "The driest summer in years", "Who owns the mill?"),
)
GERMAN = Words(
    "de",
    "Der Rat entscheidet über die alte Brücke",
    (
        "Mehrere hundert Menschen kamen heute früh auf den Platz, um zu hören, was der Rat über die alte Brücke am Fluss beschlossen hatte.",
        "Die meisten blieben bis zum Mittag, denn die Aussprache dauerte länger, als die Bürgermeisterin mit ihrem nächsten Termin geplant hatte.",
        "Die Brücke ist gesperrt, seit das Hochwasser im Frühjahr ihre Mitte mitnahm, und noch weiß niemand, was eine neue kosten würde.",
    ),
    ("Dann kam der Regen.", "Keiner sprach.", "Noch nicht.", "Das war alles.", "Im Juni wird abgestimmt."),
    ("Brot", "Wasser und zwei Äpfel", "Eine Karte", "Feste Schuhe"),
    ("Start", "Ausland", "Wirtschaft", "Sport", "Wetter", "Über uns"),
    (
        "Heute zwei Paar Schuhe kaufen und das dritte geschenkt bekommen.",
        "Unsere Matratze ist die beste Matratze, und in dieser Woche ist sie billiger als je zuvor. Bestellen Sie gleich und schlafen Sie morgen darauf.",
    ),
    (
        "Gut gesagt!",
        "Ich wohne seit vierzig Jahren am Fluss und habe noch nie ein solches Durcheinander gesehen wie das, das dieser Rat angerichtet hat.",
        "Danke fürs Aufschreiben, das wird meiner Mutter gefallen.",
    ),
    "Wir verwenden Cookies, damit diese Seite funktioniert und wir wissen, wie viele Menschen sie lesen.",
    "2020 Das Tagblatt. Alle Rechte vorbehalten, Nachdruck nur mit schriftlicher Erlaubnis des Verlags.",
    "Melden Sie sich für unseren Brief an und lesen Sie die besten Geschichten der Woche.",
    ("Schnee im April", "Der trockenste Sommer seit Jahren", "Wem gehört die Mühle?"),
)
FRENCH = Words(
    "fr",
    "Le conseil décide du vieux pont",
    (
        "Plusieurs centaines de personnes sont venues ce matin sur la place pour entendre ce que le conseil avait décidé au sujet du vieux pont.",
        "La plupart sont restées jusqu'à midi, car la discussion a duré plus longtemps que la maire, attendue ailleurs, ne l'avait prévu.",
        "Le pont est fermé depuis que la crue du printemps en a emporté le milieu, et personne ne sait encore ce qu'en coûterait un nouveau.",
    ),
    ("Puis il a plu.", "Personne ne parla.", "Pas encore.", "C'est tout.", "On votera en juin."),
    ("Du pain", "De l'eau et deux pommes", "Une carte", "De bonnes chaussures"),
    ("Accueil", "Monde", "Économie", "Sport", "Météo", "Qui sommes-nous"),
    (
        "Achetez aujourd'hui deux paires de chaussures, la troisième est offerte.",
        "Notre matelas est le meilleur des matelas, et il n'a jamais été aussi bon marché que cette semaine. Commandez-le et dormez dessus demain.",
    ),
    (
        "Bien dit !",
        "J'habite au bord de la rivière depuis quarante ans et je n'ai jamais vu un désordre pareil à celui que ce conseil a su créer.",
        "Merci d'avoir tout écrit, cela plaira à ma mère.",
    ),
    "Nous utilisons des cookies pour que ce site fonctionne et pour compter celles et ceux qui le lisent.",
    "2020 Le Quotidien. Tous droits réservés, reproduction soumise à l'accord écrit de l'éditeur.",
    "Inscrivez-vous à notre lettre et lisez les meilleures histoires de la semaine.",
    ("De la neige en avril", "L'été le plus sec depuis des années", "À qui est le moulin ?"),
)
SPANISH = Words(
    "es",
    "El consejo decide sobre el viejo puente",
    (
        "Varios cientos de personas vinieron esta mañana a la plaza para oír lo que el consejo había decidido sobre el viejo puente del río.",
        "La mayoría se quedó hasta el mediodía, porque la discusión duró más de lo que la alcaldesa, que tenía otra reunión, había previsto.",
        "El puente está cerrado desde que la crecida de la primavera se llevó su parte central, y nadie sabe aún cuánto costaría otro.",
    ),
    ("Luego llovió.", "Nadie habló.", "Todavía no.", "Eso fue todo.", "Se votará en junio."),
    ("Pan", "Agua y dos manzanas", "Un mapa", "Buenos zapatos"),
    ("Inicio", "Mundo", "Economía", "Deportes", "El tiempo", "Quiénes somos"),
    (
        "Compre hoy dos pares de zapatos y llévese gratis el tercero.",
        "Nuestro colchón es el mejor colchón, y esta semana es más barato que nunca. Pídalo ahora desde el sofá y duerma en él mañana.",
    ),
    (
        "¡Bien dicho!",
        "Vivo junto al río desde hace cuarenta años y nunca he visto un desorden como el que este consejo ha hecho de una cosa tan sencilla.",
        "Gracias por escribirlo todo, a mi madre le gustará.",
    ),
    "Usamos cookies para que este sitio funcione y para contar cuántas personas leen cada página.",
    "2020 El Diario. Todos los derechos reservados, reproducción solo con permiso escrito del editor.",
    "Suscríbase a nuestra carta y lea las mejores historias de la semana.",
    ("Nieve en abril", "El verano más seco en años", "¿De quién es el molino?"),
)
LANGUAGES = (ENGLISH, GERMAN, FRENCH, SPANISH)


def _links(texts: tuple[str, ...], between: str = " ") -> str:
    return between.join(f"<a href='/{i}'>{t}</a>" for i, t in enumerate(texts))


def _list(texts: tuple[str, ...], linked: bool = True) -> str:
    return "<ul>" + "".join(
        f"<li><a href='/{i}'>{t}</a></li>" if linked else f"<li>{t}</li>" for i, t in enumerate(texts)
    ) + "</ul>"


def _story(w: Words, turn: int) -> str:
    """A text with long and short paragraphs, and with a list, a quotation or a linked line in some turns."""
    long, short = w.long[turn % len(w.long) :] + w.long, w.short[turn % len(w.short) :] + w.short
    parts = [f"<h1>{w.title}</h1>", f"<p>{long[0]} {long[1]}</p>", f"<p>{short[0]}</p>", f"<p>{long[2]}</p>"]
    extra = [
        _list(w.items, False),
        f"<blockquote>{short[1]}</blockquote>",
        f"<p><a href='/q'>{w.more[0]}</a></p>",
        _list(w.more),
        f"<h2>{w.more[1]}</h2><p>{long[1]} <a href='/m'>{w.more[2]}</a></p>",
        f"<table><tr><td>{w.items[0]}</td><td>12 mm</td></tr></table>",
    ]
    return "".join(
        [*parts, extra[turn % len(extra)], f"<p>{long[3]}</p>", extra[(turn + 2) % len(extra)], f"<p>{short[2]}</p>"]
    )


def _comments(w: Words, open_: str = "<p>", close: str = "</p>") -> str:
    return "".join(f"{open_}{c}{close}" for c in (*w.comment, " ".join(w.comment[1:] + w.comment[:1])))


def _semantic(w: Words, t: int) -> Page:
    return [
        (f"<body><header><h2>{w.footer[5:15]}</h2><p>{w.form}</p></header><nav>{_list(w.menu)}</nav>", 0),
        (f"<div>{w.advert[t % 2]}</div>", 0),
        (f"<article>{_story(w, t)}", 1),
        (f"<aside><p>{w.long[0]}</p>{_links(w.more)}</aside>", 0),
        (f"<p>{w.long[-1]}</p></article>", 1),
        (f"<section><h3>{w.menu[5]}</h3>{_comments(w)}</section>", 0),
        (f"<footer>{w.footer}</footer></body>", 0),
    ]


def _article_short(w: Words, t: int) -> Page:
    return [
        (f"<body><nav>{_links(w.menu)}</nav><div class='x1'><p>{w.advert[1]}</p></div>", 0),
        (f"<article><h1>{w.title}</h1><p>{w.short[t % 5]}</p><p>{w.short[(t + 1) % 5]}</p></article>", 1),
        (
            f"<div class='x2'>{_comments(w)}</div><div class='x3'>{_list(w.more)}</div><footer>{w.footer}</footer></body>",
            0,
        ),
    ]


def _main(w: Words, t: int) -> Page:
    return [
        (f"<body><header>{_links(w.menu)}</header>", 0),
        (f"<main class='col'>{_story(w, t)}", 1),
        (f"<form><label>{w.menu[5]}</label><p>{w.form}</p></form>", 0),
        (f"<div class='comments'><h3>{w.menu[0]}</h3>{_comments(w)}</div></main>", 0),
        (f"<div><p>{w.notice}</p></div><div>{_links(w.more)}</div></body>", 0),
    ]


def _misleading(w: Words, t: int) -> Page:
    """Names that have a word of other parts in them, on the article and around it."""
    wrapper = ("content no-sidebar", "page has-comments", "search-result-page", "with-banner layout")[t % 4]
    inner = ("social-policy", "notice-of-meeting", "cookie-recipes", "login-trouble")[t % 4]
    return [
        (f"<body><div class='{wrapper}'><div class='menu'>{_links(w.menu)}</div>", 0),
        (f"<article class='post has-related-posts'><section class='{inner}'>{_story(w, t)}</section>", 1),
        (f"<div id='{inner}'><p>{w.short[t % 5]}</p><p>{w.long[0]}</p></div></article>", 1),
        (f"<div class='reader-comments'>{_comments(w, '<article><p>', '</p></article>')}</div></div>", 0),
        (f"<div class='ad'>{w.advert[t % 2]}</div></body>", 0),
    ]


def _misleading_div(w: Words, t: int) -> Page:
    """Pages without an article element whose text stands under a name of another part."""
    name = ("page no-sidebar", "has-sidebar", "social-policy", "sidebar")[t % 4]
    return [
        (f"<body><div class='top'>{_list(w.menu)}</div>", 0),
        (f"<div class='{name}'><p>{' '.join(w.long * 2)}</p><p>{' '.join(w.long[1:] + w.long)}</p></div>", 1),
        (f"<div class='cookie-notice'><p>{w.notice}</p></div><div class='footer'>{w.footer}</div></body>", 0),
    ]


def _divs(w: Words, t: int) -> Page:
    """Neither elements nor names tell parts apart."""
    return [
        (f"<body><div class='a1'>{_list(w.menu)}</div>", 0),
        (f"<div class='a2'>{_story(w, (0, 1, 4, 5)[t % 4])}</div>", 1),
        (f"<div class='a3'>{_list(w.more)}</div><div class='a4'>{_links(w.menu, ' | ')}</div></body>", 0),
    ]


def _divs_named(w: Words, t: int) -> Page:
    return [
        (
            f"<body><div id='nav'>{_links(w.menu, ' | ')}</div><div class='{('werbung', 'publicidad', 'advert')[t % 3]}'><p>{w.advert[1]}</p></div>",
            0,
        ),
        (f"<div class='text'>{_story(w, t)}</div>", 1),
        (f"<div class='{('kommentare', 'comentarios', 'commentaires', 'comments')[t % 4]}'>{_comments(w)}</div>", 0),
        (f"<div class='sidebar'><p>{w.long[0]}</p></div><div class='footer'>{w.footer}</div></body>", 0),
    ]


def _foreign(w: Words, t: int) -> Page:
    """Names in no list, beside an article element."""
    return [
        (
            f"<body><div class='obere-leiste'>{_links(w.menu)}</div><div class='reclame'><p>{w.advert[t % 2]}</p></div>",
            0,
        ),
        (f"<div class='inhalt'><article>{_story(w, t)}</article></div>", 1),
        (
            f"<div class='leserbriefe'><h3>{w.menu[1]}</h3>{_comments(w, '<div>', '</div>')}</div><div>{w.footer}</div></body>",
            0,
        ),
    ]


def _plain(w: Words, t: int) -> Page:
    return [
        (f"<body><p>{_links(w.menu, ' | ')}</p>", 0),
        (
            f"<h1>{w.title}</h1><p>{w.long[0]} {w.long[1]}</p><p>{w.long[1]}</p><p>{w.long[2]} <a href='/q'>{w.more[0]}</a></p>",
            1,
        ),
        (f"<p><a href='/z'>{w.more[1]}</a></p></body>", 0),
    ]


def _table(w: Words, t: int) -> Page:
    return [
        (f"<body><table><tr><td><p>{w.long[0]} {w.long[1]}</p><p>{w.long[2]}</p></td></tr></table>", 1),
        (f"<table><tr><td>{_links(w.menu, '</td><td>')}</td></tr></table></body>", 0),
    ]


def _unclosed(w: Words, t: int) -> Page:
    return [
        (f"<body><nav>{_links(w.menu)}</nav>", 0), (f"<article><h1>{w.title}</h1><p>{w.long[t % 3]}<p>{w.short[0]}", 1)
    ]


def _no_text(w: Words, t: int) -> Page:
    return [
        (f"<body><div>{_list(w.menu)}</div><div class='banner'><p>{w.advert[t % 2]}</p></div>", 0),
        (f"<div role='alert'><p>{w.notice}</p></div><form><p>{w.form}</p></form><footer>{w.footer}</footer></body>", 0),
    ]


LAYOUTS: dict[str, Callable[[Words, int], Page]] = {
    "semantic": _semantic,
    "article, short": _article_short,
    "main": _main,
    "misleading names": _misleading,
    "misleading names, no article": _misleading_div,
    "neutral divs": _divs,
    "named divs": _divs_named,
    "foreign names": _foreign,
    "plain": _plain,
    "table": _table,
    "unclosed": _unclosed,
    "no text": _no_text,
}


def labelled_pages(layouts: list[str] | None = None, turns: range = range(4)) -> list[Page]:
    """A page for each layout, language and turn."""
    return [LAYOUTS[name](w, t) for name in layouts or LAYOUTS for w in LANGUAGES for t in turns]
