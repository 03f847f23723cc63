"""Hand-checked texts for calibration: (text, is prose). Written for this purpose, read and labelled by hand."""

HOLDOUT: list[tuple[str, bool]] = [
    ("The committee met on Tuesday to discuss the damaged shelves. After an hour of talk they agreed to order new ones before winter.", True),
    ("If the pump stops at night, the guard calls the engineer, who\nusually arrives within half an hour. The log is signed by both.", True),
    ("3.2 We scanned every page twice, because the first pass had lost the margins. The second pass was better, although some corners stayed dark.", True),
    ("* 4: The figures for March were corrected later, when the missing slips had been found in a drawer of the old desk.", True),
    ("- The clerk opens the box, counts the letters and writes the sum on the lid.\n- The driver checks the sum and takes the box to the depot.", True),
    ("THE READER WILL NOTICE THAT THE MAP WAS DRAWN BY HAND. IT SHOWS THE VALLEY BEFORE THE DAM WAS BUILT, AND THE OLD ROAD.", True),
    ("the model is loaded once per worker and stays in memory, so that the next request doesnt have to wait. this was noted in the log", True),
    ("Tbe archive keeps all volurnes that were printed before 1900. Visitors rnay read them in the hall, but they must not be taken horne.", True),
    ("A short sentence comes first. Then follows a much longer one, which explains\nwhy the first was so short and what the author thought about it. (see B12: 4 / 20, 20 %)", True),
    ("Der Ausschuss hat den Bericht gelesen und kleine Änderungen verlangt. Danach wurde er einstimmig angenommen und an das Amt geschickt.", True),
    ("Wegen des Regens konnten die Karten nicht getrocknet werden, und\nder Versand wurde um eine Woche verschoben. Niemand beschwerte sich.", True),
    ("Nach 40 Minuten hält die Maschine an, weil das Papier zu Ende ist. Der Lehrling legt neues nach und startet sie wieder.", True),
    ("Le bureau a reçu la lettre le matin même, mais personne ne l'a ouverte avant midi. La réponse est partie le lendemain.", True),
    ("Selon le rapport, les pages manquantes ont été retrouvées dans une autre boîte. Elles seront numérisées avant la fin du mois.", True),
    ("El archivo abre a las nueve, y los lectores deben dejar sus bolsos en la entrada. Las fotografías están permitidas sin flash.", True),
    ("Cuando la lámpara se calienta, el operador comprueba la imagen y ajusta el contraste. Después empieza la copia.", True),
    ("Il comune ha approvato il contratto dopo una lunga discussione. I lavori cominceranno in primavera, se il tempo lo permette.", True),
    ("A biblioteca guarda os mapas num armário seco. Quem quiser consultá-los deve pedir a chave ao encarregado e assinar a lista.", True),
    ("De gemeente heeft het verslag ontvangen en zal volgende week antwoorden. Tot die tijd blijft het oude rooster gelden.", True),
    ("Совет рассмотрел отчёт и попросил исправить две таблицы. После этого документ был подписан и отправлен в архив.", True),
    ("委员会在周二讨论了受损的书架。经过一个小时的讨论，他们决定在冬天之前订购新的书架，并且通知了仓库。", True),
    ("如果水泵在夜里停止，值班人员就打电话给工程师，他一般\n在半小时之内赶到。两个人都要在日志上签名。", True),
    ("委員会は火曜日に集まり、壊れた棚について話し合いました。冬の前に新しい棚を注文することにしましたが、予算はまだ決まっていません。", True),
    ("夜にポンプが止まると、係員は技術者に電話します。技術者はたいてい三十分以内に来て、\n日誌に署名します。", True),
    ("위원회는 화요일에 모여 망가진 선반에 대해 이야기했습니다. 겨울이 오기 전에 새 선반을 주문하기로 했습니다.", True),
    ("종이가 젖었기 때문에 담당자는 작업을 멈추었습니다. 다음 날 아침에 다시 시작했고 점심 전에 끝났습니다.", True),
    ("The old\nharbour was\nclosed in\nMay, but the\nnew one will\nopen only\nnext year.\nUntil then\nships wait\noutside.", True),
    ("该小组核对了全部页面o然后他们把结果保存在服务器上，但是没有人通知读者，所以第二天又重新做了一遍。", True),
    ("The red box\nThe minutes of May\nA list of readers\nThe old harbour\nOur night shift\nThe drawings of the bridge", False),
    ("1. Opening of the meeting\n2. Report of the clerk\n3. Budget for the year\n4. New shelves\n5. Any other matter", False),
    ("[x] Lamp\n[ ] Spare paper\n[x] Keys of the depot\n[ ] Signature of the driver\n[ ] Map of the valley", False),
    ("- Milk and bread\n- Two reams of paper\n- Ink for the old printer\n- A box of clips\n- The repaired lamp", False),
    ("a) The engine; b) The left pump; c) The spare filter; d) The control panel; e) The manual for the crane; f) The oil", False),
    ("Der Kran\nDie linke Pumpe\nDas Handbuch\nDer alte Hafen\nEine Liste der Leser\nDie Schlüssel des Lagers\nDer Vertrag", False),
    ("Les plans du pont; La clé du dépôt; Une liste des lecteurs; Le vieux port; Les lettres de mai; Le contrat de travail", False),
    ("El puerto viejo\nLas llaves del almacén\nUna lista de lectores\nLos planos del puente\nEl contrato de trabajo", False),
    ("旧港口\n桥梁的图纸\n读者名单\n仓库的钥匙\n五月的信件\n劳动合同\n左边的水泵\n起重机的说明书", False),
    ("古い港\n橋の図面\n読者の一覧\n倉庫の鍵\n五月の手紙\n労働契約\n左のポンプ\nクレーンの説明書", False),
    ("낡은 항구\n다리의 도면\n독자 목록\n창고 열쇠\n오월의 편지\n노동 계약\n왼쪽 펌프\n기중기 설명서", False),
    ("Pump 12 4.5 n/a 88% Crane 7 - 310 12% Lamp 4 2.25 18 n/a Filter 90 - - 4% Engine 1 12,300 2 55.0%", False),
    ("Pump\n12\n4.5\nn/a\n88%\nCrane\n7\n-\n310\n12%\nLamp\n4\n2.25\n18\nn/a\nFilter\n90\n-\n-", False),
    ("| Pump | 12 | 4.5 | n/a |\n| Crane | 7 | - | 310 |\n| Lamp | 4 | 2.25 | 18 |\n| Filter | 90 | - | 6 |", False),
    ("Pump,12,4.5,n/a,88%\nCrane,7,-,310,12%\nLamp,4,2.25,18,n/a\nFilter,90,-,-,4%\nEngine,1,12300,2,55.0%", False),
    ("Pump\t12\t4.5\tn/a\nCrane\t7\t-\t310\nLamp\t4\t2.25\t18\nFilter\t90\t-\t6\nEngine\t1\t12,300\t2", False),
    ("桥梁图纸 12 4.5 n/a 88% 仓库钥匙 7 - 310 12% 读者名单 4 2.25 18 n/a 旧港口 90 - - 4% 水泵 1 12,300", False),
    ("Чертежи моста 12 4.5 n/a Ключи склада 7 - 310 Список читателей 4 2.25 18 Старый порт 90 - 6 Насос 1 12", False),
    ("Introduction .......... 1\nThe old harbour .......... 7\nBridges and roads .......... 19\nIndex .......... 88", False),
    ("引言 ............ 1\n旧港口 ............ 7\n桥梁和道路 ............ 19\n索引 ............ 88\n附录 ............ 90", False),
    ("Name: Pump 12\nPlace: Depot\nState: 88%\nChecked by: Ollen\nDate: 04-05\nNext check: -\nRemarks: none", False),
    ("名称: 水泵\n地点: 仓库\n状态: 88%\n检查人: -\n日期: 04-05\n编号: R-7\n备注: 无\n型号: X20\n数量: 14", False),
    ('width=1024\nheight=768\nmode="fast"\nlimit=null\nmask=0x3fa2\npages=[1,2,9]\nname="ollen"\nretry=3', False),
    ('{"id": 17, "box": [1, 2, 3, 4], "kind": "cell", "ok": null}, {"id": 18, "box": [5, 6, 7, 8], "kind": "row"}', False),
    ("4f 0a 99 c3 1e 77 b0 00 fe 12 8d 6a 55 34 f1 c9 20 ab cd 07 3e 91 44 d8 6f 02 b7 e5 18 a0 5c 73 ff 09", False),
    ("QmFzZTY0IHRleHQgbG9va3MgbGlrZSB0aGlzIHdoZW4gaXQgaXMgbm90IGRlY29kZWQgYnkgYW55b25lIGF0IGFsbCAxMjM0NTY3ODk=", False),
    ("~~^|;:,.-_=+*/<>`'\\|~^ -=;:.,<>_|/ ^~+*=-.;:,'`|<>/\\~^-_=+*.,;: |/<>^~`'-=_+*;:.,|<>\\/~^", False),
    ("lll 11 II ■■ □ § ¤¤ \\\\ . . .. I 1 ll ■ □□ §§ ¤ \\ . .. lll III 111 ■■■ □ § \\\\\\ .. . ll 1 I ■ ¤¤", False),
    ("xqv brtl k wzn pfd l1k vv q jtr mnb xxk ll zrt wq pl kkd b vcx zt rrl qw mnp s dfg hjk l zx cvb nm", False),
    ("______________________________\n- - - - - - - - - - - - - - - -\n==============================\n..............................", False),
    ("å¤å¤ã®éã«ãè¡¨ã®èªèå¦çã226è¡ç®ã®ç©ºã®ã»ã«ãä¿åãã¾ãããå³æ¸é¤¨ã¯ä¸åº¦", False),
    ("0.4 0.8 1.5 2.2 3.9 7.1 12.0 0.2 0.1 -0.4 -0.9 5.5 6.0 6.1 6.2 8.8 9.0 9.4 10.2 11.7 12.9 13.3 14.1 15.0", False),
    ("12:04:55 INFO stage=load ms=17 ok\n12:04:56 INFO stage=ocr ms=311 ok\n12:04:59 WARN stage=table ms=2999 retry=1", False),
    ("Doorne, P. 1999, 12-19; Ollen, K. 2003, 44-58; Varga, T. 2007, 3-9; Marsh, L. 2011, 201-219; Tann, S. 2014, 8", False),
]
