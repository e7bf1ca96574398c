"""Fixed texts: the article prompt template and the fallback article.

These are data that must equal the original wording for equal output; the
prompt has three ``{source_url}`` slots and one ``{full_content}`` slot.
"""

# ---- FIXED VALUES: prompt template (A2) ----
PROMPT_TEMPLATE = """
あなたは日本のアニメポップアップストア専門のライターです。

以下のサイト情報から、ポップアップストアの記事を生成してください。

【出力指示】
以下のHTML構成で記事を作成してください：

<h2>メタディスクリプション</h2>
<p>（描き下ろしイラスト時）
[作者名]先生による人気漫画を原作としたアニメ「[作品名]」× [メーカー名]のポップアップストアが、[店舗名]にて2025年N月NN日〜NNN月NNNN日まで開催される。アニメ「[作品名]」ポップアップストアでは、描き下ろしイラストを使用した新作グッズが多数ラインナップ!</p>

<p>（描き下ろしイラストじゃない時）
[作者名]先生による人気漫画を原作としたアニメ「[作品名]」× [メーカー名]のポップアップストアが、[店舗名]にて2025年N月NN日〜NNN月NNNN日まで開催される。アニメ「[作品名]」ポップアップストアでは、[キャラ名]・[キャラ名]・[キャラ名]らの描き下ろしイラストを使用した新作グッズが多数ラインナップ！</p>

<h2>リード文</h2>
<p>（描き下ろしイラストの場合）
[作者名]先生による人気漫画を原作としたアニメ「[作品名]」× [メーカー名]のポップアップストアが、[店舗名]にて2025年N月NN日〜NNN月NNNN日まで開催される。
アニメ「[作品名]」ポップアップストアでは、イベント限定の描き下ろしイラストを使用した新作グッズが多数販売される他、グッズをお買い上げ[価格]円(税込)ごとに特典として描き下ろしノベルティ「[ノベルティ名] 全[種類数]種」をランダムに1枚プレゼント!</p>

<p>（描き下ろしイラストではない場合）
[作者名]先生による人気漫画を原作としたアニメ「[作品名]」× [メーカー名]のポップアップストアが、[店舗名]にて2025年N月NN日〜NNN月NNNN日まで開催される。
「[イベント名]」ポップアップストアでは、作品に登場する人気キャラクターたちのアニメビジュアルを使用したグッズが多数販売される他、「[作品名]」関連商品を含めて、[価格]円(税込)お買い上げ毎に特典として「[ノベルティ名] (全[種類数]種)」をランダムに1枚プレゼント!</p>

<h2>[イベント名] ポップアップストア in [店舗名]のグッズ</h2>
<p>[開催日]より「[店舗名]」にて、「[作品名]」のポップアップストアを開催!</p>

<h3>グッズラインナップ</h3>
<div>-適切な画像を挿入ー</div>

<p>以下広告のあとに記事が続きます</p>

<h2>[作品名] ポップアップストア in [店舗名]のノベルティー</h2>
<p>「[作品名]」ポップアップストアにて、グッズをお買い上げ[価格]円毎に特典として「[ノベルティ名] 全[種類数]種」がランダムに1枚プレゼントされる。</p>

<h3>お買い上げ特典 - [ノベルティ名] 全[種類数]種/ランダム</h3>
<div>-適切な画像を挿入ー</div>

<h2 id="pop-up-summary">[作品名] ポップアップストア in [店舗名] [開催日]より開催!</h2>
<div>-適切な画像を挿入ー</div>

<h3>開催情報</h3>
<p>公式サイト：<a href="{source_url}" target="_blank">特設ページ</a></p>
<p>開催場所：[店舗名]</p>
<p>開催期間：[開催期間]</p>
<p>お問い合わせ：<a href="{source_url}" target="_blank">[メーカー名]</a>にお問い合わせください。</p>

<p>以下広告のあとに記事が続きます</p>

<p>詳細は公式サイトをご確認ください。</p>
<p>※記事の情報が古い場合がありますのでお手数ですが公式サイトの情報をご確認下さい。</p>

【重要】
- サイト情報から具体的な情報を抽出し、[作品名]、[店舗名]、[開催日]、[価格]などを実際の情報に置き換えてください
- 画像プレースホルダー「-適切な画像を挿入ー」を3箇所に配置してください
- 推測や創作はせず、実際の情報のみを使用してください
- HTMLタグは正しく閉じてください

【元サイト情報】
URL: {source_url}
サイト全文: {full_content}
"""

# ---- FIXED VALUES: system message beside the prompt (A2) ----
SYSTEM_MESSAGE = "あなたは日本のアニメポップアップストア専門のライターです。"

# ---- FIXED VALUES: fallback article used when no generation is usable (A3) ----
FALLBACK_ARTICLE_HTML = """
<h1>メタディスクリプション</h1>
<p>人気アニメのポップアップストアが開催されます。詳細は公式サイトをご確認ください。</p>

<h2>リード文</h2>
<p>アニメポップアップストアでは、作品に関連したグッズが多数販売される予定です。</p>

<h2>ポップアップストアのグッズ</h2>
<p>ポップアップストアを開催!</p>

<h3>グッズラインナップ</h3>
<div>-適切な画像を挿入ー</div>

<p>以下広告のあとに記事が続きます</p>

<h2>ポップアップストアのノベルティー</h2>
<p>グッズをお買い上げの方に特典をプレゼント。</p>

<h3>お買い上げ特典</h3>
<div>-適切な画像を挿入ー</div>

<h2>ポップアップストア開催!</h2>
<div>-適切な画像を挿入ー</div>

<h3>開催情報</h3>
<p>詳細は公式サイトをご確認ください。</p>

<p>以下広告のあとに記事が続きます</p>

<p>詳細は公式サイトをご確認ください。</p>
<p>※記事の情報が古い場合がありますのでお手数ですが公式サイトの情報をご確認下さい。</p>
"""

# ---- FIXED VALUES: error article (A5); {source_url} is filled per page ----
ERROR_ARTICLE_HTML = ("<p>記事の生成中にエラーが発生しました。詳細は<a href='{source_url}' "
                      "target='_blank'>公式サイト</a>をご確認ください。</p>")


def prompt_parts():
    """Split the template at its slots: literal, slot name, literal, ..."""
    import re
    return re.split(r"\{(source_url|full_content)\}", PROMPT_TEMPLATE)
